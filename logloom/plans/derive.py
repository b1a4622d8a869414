"""Log-shaped relations out of the star-schema tables, in SQL that Spark and DuckDB read alike."""

#: One log for each event: its service, place, level, message, decision and truth.
LOGS = """
SELECT cast(event_id AS bigint) AS event_id, 'ev' AS dataset_id, event_type AS service, concat(event_type, '.log') AS source_file,
  cast(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS bigint) AS sequence, cast(ts AS timestamp) AS ts,
  concat('u', cast(user_id AS string)) AS thread, concat('t', cast(user_id AS string)) AS trace_id,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  CASE event_type WHEN 'click' THEN concat('Clicked item ', cast(event_id AS string)) WHEN 'purchase' THEN concat('Order ', cast(event_id AS string), ' placed')
    WHEN 'error' THEN concat('Request failed for user ', cast(user_id AS string)) WHEN 'view' THEN concat('Opened page ', cast(event_id AS string)) ELSE concat('Account ', cast(user_id AS string), ' created twice') END AS message,
  concat('s', cast(user_id % 7 AS string)) AS predicted,
  CASE WHEN value < 10 THEN 'unmatched' WHEN value < 20 THEN 'ambiguous' ELSE 'matched' END AS status,
  CASE WHEN value < 10 THEN NULL WHEN value < 20 THEN 'low' WHEN value < 50 THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN event_id % 11 = 0 THEN 'unknown' WHEN event_id % 13 = 0 THEN 'not_in_catalog' ELSE 'known' END AS truth_state,
  concat('s', cast(CASE WHEN event_id % 3 = 0 THEN (user_id + 1) % 7 ELSE user_id % 7 END AS string)) AS truth
FROM events"""

#: Statements that these logs can come from, with classes, levels and templates.
STATEMENTS = """
SELECT * FROM (VALUES
  ('s-click', 'click', 'com.shop.web.ClickController', 'INFO', 'Clicked item {}', 'placeholders', 10),
  ('s-open', 'view', 'com.shop.web.PageController', 'DEBUG', 'Opened page {}', 'placeholders', 20),
  ('s-order', 'purchase', 'com.shop.order.OrderService', 'INFO', 'Order {} placed', 'placeholders', 30),
  ('s-order2', 'purchase', 'com.shop.order.OrderService', 'INFO', 'Order {}', 'placeholders', 40),
  ('s-fail', 'error', 'com.shop.web.ErrorAdvice', 'ERROR', 'Request failed for user {}', 'placeholders', 50),
  ('s-any', 'error', 'com.shop.web.ErrorAdvice', 'ERROR', '{}', 'dynamic', 60),
  ('s-account', 'signup', 'com.shop.account.AccountService', 'WARN', 'Account {} created', 'placeholders', 70)
) AS t(statement_id, service, class_fqn, level, template, template_kind, line)"""

#: The place of an event among its type's, as LOGS counts it, and LOGS over events that have it as ``place`` already.
PLACE = "row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1"
PLACED_LOGS = LOGS.replace(PLACE, "place").replace("FROM events", "FROM {events}")
