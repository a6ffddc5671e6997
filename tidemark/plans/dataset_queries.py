"""Queries over texts, splits, encodings, metrics and state tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timezones as Z
from ..operators import metrics as M
from ..operators import prep as P
from ..operators import state as ST
from ..operators.ranks import correlation, correlation_p
from ..scratch import scratch_path
from ..sources import tables as S
from ..sources.versioned import Store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as messages with a ticker, a link and an emoji."""
    d = S.table(spark, sf, "documents")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" $"), F.upper("source"), F.lit(" https://x.com/a/status/"), F.col("doc_id").cast("string"), F.lit(" 🚀"))
    return d.select("doc_id", "lang", "source", text.alias("text"))


MESSAGES = """
messages AS (SELECT doc_id, lang, source, coalesce(text, '') || ' $' || upper(source) || ' https://x.com/a/status/' || CAST(doc_id AS VARCHAR) || ' 🚀' AS text FROM documents)"""


@query("SELECT doc_id, substr(md5(text), 1, 12) AS tweet_hash FROM documents")
def text_hash(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", X.tweet_hash(F.col("text")).alias("tweet_hash"))


@query(rf"WITH {MESSAGES} SELECT doc_id, array_to_string(regexp_extract_all(text, '\$([A-Z][A-Z0-9]*)', 1), ' ') AS tickers FROM messages")
def text_tickers(spark, sf):
    return messages(spark, sf).select("doc_id", F.array_join(X.tickers(F.col("text")), " ").alias("tickers"))


@query(rf"WITH {MESSAGES} SELECT DISTINCT doc_id, upper(unnest(regexp_extract_all(text, '\$([A-Z][A-Z0-9]*)', 1) || [source])) AS ticker FROM messages")
def text_explode(spark, sf):
    found = F.array_distinct(F.transform(F.concat(X.tickers(F.col("text")), F.array("source")), lambda x: F.upper(x)))
    return messages(spark, sf).select("doc_id", F.explode(found).alias("ticker"))


@query(rf"WITH {MESSAGES} SELECT doc_id, regexp_extract(text, '(https?://(?:twitter\.com|x\.com)/[^\s)]+)', 1) AS url FROM messages")
def text_url(spark, sf):
    return messages(spark, sf).select("doc_id", X.tweet_url(F.col("text")).alias("url"))


@query(rf"""WITH {MESSAGES}, unlinked AS (SELECT doc_id, regexp_replace(text, 'https?://\S+', '', 'g') AS t FROM messages),
joined AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS t FROM unlinked),
plain AS (SELECT doc_id, replace(regexp_replace(t, '\\([()\[\]{{}}.,!?\-''#+_])', '\1', 'g'), chr(10), ' ') AS t FROM joined)
SELECT doc_id, trim(regexp_replace(replace(t, '🚀', ' [rocket] '), ' {{2,}}', ' ', 'g')) AS clean FROM plain""")
def text_clean(spark, sf):
    return messages(spark, sf).select("doc_id", X.clean_message(F.col("text")).alias("clean"))


@query(r"""WITH n AS (SELECT doc_id, text, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters,
  length(regexp_replace(text, '[^A-Za-z\x{aa}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]', '', 'g')) AS latin FROM documents)
SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN false WHEN letters = 0 THEN true ELSE (letters - latin) / letters < 0.2 END AS is_english FROM n""")
def text_is_english(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", X.is_english(F.col("text")).alias("is_english"))


def _cases() -> str:
    quote = lambda w: w.replace("'", "''")
    return " ".join("WHEN " + " OR ".join(f"contains(low, '{quote(w)}')" for w in words) + f" THEN '{quote(name)}'" for name, words in X.TOPICS.items())


@query(f"SELECT doc_id, CASE {_cases()} ELSE 'Other' END AS category FROM (SELECT doc_id, lower(text) AS low FROM documents)")
def text_categorize(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", X.categorized(F.col("text")).alias("category"))


@query("""SELECT event_id, timezone('UTC', timezone('America/New_York', ts)) AS utc_ts FROM events""")
def time_normalize(spark, sf):
    return S.table(spark, sf, "events").select("event_id", Z.to_instant(F.col("ts")).cast("timestamp_ntz").alias("utc_ts"))


@query("""WITH d AS (SELECT o_orderkey, o_orderkey % 6 AS k, CASE WHEN o_orderkey % 6 = 4 THEN o_custkey * 997 + 1 ELSE o_custkey % 400 + 1 END AS n FROM orders),
c AS (SELECT o_orderkey, CASE k WHEN 0 THEN n || ' Y' WHEN 1 THEN n || 'M' WHEN 2 THEN n || ' D' WHEN 3 THEN ' ' || n || ' w ' WHEN 4 THEN n || ' S' ELSE n || ' soon' END AS duration,
  CAST(CASE k WHEN 0 THEN n * 365 WHEN 1 THEN n * 30 WHEN 2 THEN n WHEN 3 THEN n * 7 WHEN 4 THEN greatest(1, n // 86400) ELSE 200 END AS BIGINT) AS calendar_days FROM d)
SELECT *, calendar_days - 2 * (calendar_days // 7) AS trading_days FROM c""")
def duration_days(spark, sf):
    """Durations of an order's number and customer, written in each form and one that is none."""
    k, n = F.col("o_orderkey") % 6, F.when(F.col("o_orderkey") % 6 == 4, F.col("o_custkey") * 997 + 1).otherwise(F.col("o_custkey") % 400 + 1).cast("string")
    text = F.when(k == 0, F.concat(n, F.lit(" Y"))).when(k == 1, F.concat(n, F.lit("M"))).when(k == 2, F.concat(n, F.lit(" D"))).when(k == 3, F.concat(F.lit(" "), n, F.lit(" w "))).when(k == 4, F.concat(n, F.lit(" S"))).otherwise(F.concat(n, F.lit(" soon")))
    d = S.table(spark, sf, "orders").select("o_orderkey", text.alias("duration"))
    return d.select("o_orderkey", "duration", Z.calendar_days(F.col("duration")).alias("calendar_days"), Z.trading_days(F.col("duration")).alias("trading_days"))


def _hashed(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", "source", "lang", X.tweet_hash(F.col("text")).alias("tweet_hash"))


HASHED = """hashed AS (SELECT doc_id, source, lang, substr(md5(text), 1, 12) AS tweet_hash FROM documents),
parts AS (SELECT *, CAST('0x' || substr(tweet_hash, 1, 8) AS BIGINT) % 1000 AS k FROM hashed),
split AS (SELECT * EXCLUDE (k), CASE WHEN k < 100 THEN 'test' WHEN k < 200 THEN 'val' ELSE 'train' END AS split FROM parts)"""


@query(f"WITH {HASHED} SELECT doc_id, tweet_hash, split FROM split")
def split_hash(spark, sf):
    return P.split_by_hash(_hashed(spark, sf)).select("doc_id", "tweet_hash", "split")


@query("""WITH p AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN i < CAST(trunc(n * (1 - 0.1 - 0.1)) AS BIGINT) THEN 'train' WHEN i < CAST(trunc(n * (1 - 0.1)) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM p""")
def split_time(spark, sf):
    return P.split_by_time(S.table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "split")


@query(f"WITH {HASHED} SELECT split, count(*) AS n_rows, count(DISTINCT tweet_hash) AS n_hashes, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM split GROUP BY split")
def split_summary(spark, sf):
    return P.split_summary(P.split_by_hash(_hashed(spark, sf)))


@query("""WITH p AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
s AS (SELECT *, CASE WHEN i < CAST(trunc(n * 0.8) AS BIGINT) THEN 'train' WHEN i < CAST(trunc(n * 0.9) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM p)
SELECT split, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY split""")
def temporal_summary(spark, sf):
    return P.temporal_summary(P.split_by_time(S.table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]))


@query("""WITH s AS (SELECT substr(md5(text), 1, 12) AS tweet_hash, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM documents)
SELECT tweet_hash, count(DISTINCT split) AS n_splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def leakage_check(spark, sf):
    m = F.col("doc_id") % 3
    return P.leaking(_hashed(spark, sf).withColumn("split", F.when(m == 0, "train").when(m == 1, "val").otherwise("test")))


@query(f"""WITH {HASHED}, firsts AS (SELECT source AS value, min(doc_id) AS o FROM split WHERE split = 'train' AND source <> 'src3' GROUP BY 1),
idx AS (SELECT value, row_number() OVER (ORDER BY o, value) - 1 AS idx FROM firsts)
SELECT doc_id, source, CAST(coalesce(idx, 0) AS INTEGER) AS source_idx FROM split LEFT JOIN idx ON source = value""")
def encode_categorical(spark, sf):
    df = P.split_by_hash(_hashed(spark, sf))
    known = P.encodings(df.where("split = 'train' and source <> 'src3'"), "source", "doc_id")
    return P.encoded(df, {"source": known}).select("doc_id", "source", "source_idx")


@query("""WITH f AS (SELECT event_id, coalesce(value, 0) AS value, event_id % 10 < 8 AS train FROM events), s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM f WHERE train)
SELECT event_id, round((value - m) / CASE WHEN d > 0 THEN d ELSE 1 END, 6) AS value FROM f, s""")
def scale_features(spark, sf):
    df = S.table(spark, sf, "events").select("event_id", "value")
    return P.scaled(df, ["value"], P.scaler(df.where("event_id % 10 < 8"), ["value"])).select("event_id", F.round("value", 6).alias("value"))


@query("""WITH n AS (SELECT label % 3 AS label, count(*) AS n FROM embeddings GROUP BY 1), w AS (SELECT label, n, sum(n) OVER () / (count(*) OVER () * n) AS balanced FROM n)
SELECT CAST(label AS INTEGER) AS label, n, round(balanced, 6) AS balanced, round(sqrt(balanced) / avg(sqrt(balanced)) OVER (), 6) AS rooted, round(CASE WHEN label = 2 THEN balanced * 1.5 ELSE balanced END, 6) AS boosted FROM w""")
def class_weights(spark, sf):
    p = S.predictions(spark, sf)
    out = P.class_weights(p).select("label", "n", F.round("weight", 6).alias("balanced"))
    out = out.join(P.class_weights(p, mode="sqrt").select("label", F.round("weight", 6).alias("rooted")), "label")
    return out.join(P.class_weights(p, buy_boost=1.5).select("label", F.round("weight", 6).alias("boosted")), "label")


PRED = f"WITH {S.PREDICTIONS}"


@query(PRED + " SELECT label, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1, count(*) FILTER (pred = 2) AS pred_2 FROM predictions GROUP BY label")
def confusion_matrix(spark, sf):
    return M.confusion(S.predictions(spark, sf))


REPORT = PRED + """, report AS (SELECT class, count(*) FILTER (pred = class AND label = class) AS tp, count(*) FILTER (pred = class) AS predicted, count(*) FILTER (label = class) AS support
  FROM predictions, (VALUES (0), (1), (2)) AS c(class) GROUP BY class),
f AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision_, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall_,
  CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1 FROM report)
"""


@query(REPORT + """SELECT class, tp, predicted, support, round(precision_, 6) AS "precision", round(recall_, 6) AS recall, round(f1, 6) AS f1 FROM f""")
def classification_report(spark, sf):
    return M.class_report(S.predictions(spark, sf)).select("class", "tp", "predicted", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(REPORT + "SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1) FILTER (support > 0 OR predicted > 0), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM f")
def f1_scores(spark, sf):
    return M.scores(S.predictions(spark, sf)).select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted")])


@query(PRED + """, n AS (SELECT label, count(*) AS n FROM predictions GROUP BY label), p AS (SELECT *, n / sum(n) OVER () AS p FROM n)
SELECT round(max(p), 6) AS naive_accuracy, (SELECT label FROM n ORDER BY n DESC, label LIMIT 1) AS majority_class, round(1 / count(*), 6) AS random_accuracy, round(sum(p * p), 6) AS weighted_random_accuracy FROM p""")
def baselines(spark, sf):
    return M.baselines(S.predictions(spark, sf)).select("majority_class", *[F.round(c, 6).alias(c) for c in ("naive_accuracy", "random_accuracy", "weighted_random_accuracy")])


RANKED = """ranked AS (SELECT rank() OVER (ORDER BY p_buy - p_sell) + (count(*) OVER (PARTITION BY p_buy - p_sell) - 1) / 2 AS a,
  rank() OVER (ORDER BY ret) + (count(*) OVER (PARTITION BY ret) - 1) / 2 AS b FROM predictions WHERE ret IS NOT NULL)"""


@query(PRED + f", {RANKED} SELECT count(*) AS n, round(corr(a, b), 6) AS ic FROM ranked")
def trading_ic(spark, sf):
    return M.information_coefficient(S.predictions(spark, sf)).select("n", F.round("ic", 6).alias("ic"))


@query(PRED + """ SELECT round(count(*) FILTER (CASE WHEN pred = 2 THEN ret > 0 ELSE ret < 0 END) / count(*), 6) AS directional_accuracy, count(*) AS n_directional FROM predictions WHERE ret IS NOT NULL AND pred <> 1 AND ret <> 0""")
def trading_directional(spark, sf):
    return M.directional(S.predictions(spark, sf)).select(F.round("directional_accuracy", 6).alias("directional_accuracy"), "n_directional")


@query(PRED + """, v AS (SELECT *, row_number() OVER (ORDER BY conf DESC, id) AS k, count(*) OVER () AS n FROM predictions WHERE ret IS NOT NULL),
t AS (SELECT CASE pred WHEN 2 THEN ret - 0.001 WHEN 0 THEN -ret - 0.001 ELSE 0 END AS r FROM v WHERE k <= greatest(1, CAST(trunc(0.3 * n) AS BIGINT)))
SELECT count(*) AS n_top_trades, round(avg(r) / stddev_pop(r) * sqrt(252), 6) AS sharpe_top, round(avg(r) * 252, 6) AS return_top FROM t""")
def trading_sharpe_top(spark, sf):
    return M.top_trades(S.predictions(spark, sf)).select("n_top_trades", F.round("sharpe_top", 6).alias("sharpe_top"), F.round("return_top", 6).alias("return_top"))


@query(PRED + """ SELECT count(*) AS n_high_confidence, CASE WHEN count(*) >= 10 THEN round(count(*) FILTER (pred = label) / count(*), 6) END AS precision_at_confidence FROM predictions WHERE ret IS NOT NULL AND conf > 0.6""")
def precision_at_confidence(spark, sf):
    return M.precision_at(S.predictions(spark, sf)).select("n_high_confidence", F.round("precision_at_confidence", 6).alias("precision_at_confidence"))


SWEEP = PRED + f""", limits(threshold) AS (VALUES {", ".join(f"({t}::DOUBLE)" for t in M.THRESHOLDS)}),
m AS (SELECT *, CASE pred WHEN 2 THEN ret - 0.001 WHEN 0 THEN -ret - 0.001 ELSE 0 END AS r FROM limits, predictions WHERE conf >= threshold),
g AS (SELECT threshold, count(*) AS n_samples, count(ret) AS n_valid, count(*) FILTER (pred = label) AS hits,
  count(*) FILTER (ret IS NOT NULL AND pred <> 1) AS n_calls, count(*) FILTER (ret <> 0 AND pred <> 1) AS n_moved,
  count(*) FILTER (pred = 2 AND ret > 0 OR pred = 0 AND ret < 0) AS n_right, count(*) FILTER (ret IS NOT NULL AND r <> 0) AS n_trades,
  count(*) FILTER (ret IS NOT NULL AND r > 0) AS wins, avg(r) FILTER (ret IS NOT NULL AND r <> 0) AS mean, stddev_pop(r) FILTER (ret IS NOT NULL AND r <> 0) AS dev, avg(conf) AS mean_confidence,
  {", ".join(f"count(*) FILTER (pred = {c} AND label = {c}) AS tp{c}, count(*) FILTER (pred = {c}) AS p{c}, count(*) FILTER (label = {c}) AS o{c}" for c in M.CLASSES)}
  FROM m GROUP BY threshold),
f AS (SELECT *, n_samples >= 20 AND n_valid >= 20 AS fine, n_trades > 10 AND dev > 0 AS trades,
  {", ".join(f"CASE WHEN p{c} + o{c} > 0 THEN 2 * tp{c} / (p{c} + o{c}) END AS f{c}" for c in M.CLASSES)} FROM g),
sweep AS (SELECT l.threshold, coalesce(n_samples, 0) AS n_samples, CASE WHEN coalesce(n_samples, 0) < 20 THEN 'insufficient_samples' WHEN n_valid < 20 THEN 'insufficient_valid_returns' ELSE 'ok' END AS status,
  round(coalesce(n_samples, 0) / (SELECT count(*) FROM predictions), 6) AS coverage, CASE WHEN fine THEN round(hits / n_samples, 6) END AS accuracy,
  CASE WHEN fine THEN round((coalesce(f0, 0) + coalesce(f1, 0) + coalesce(f2, 0)) / ((f0 IS NOT NULL)::INT + (f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT), 6) END AS f1_macro,
  CASE WHEN fine AND o0 > 0 THEN round(tp0 / o0, 6) END AS sell_accuracy, CASE WHEN fine AND o1 > 0 THEN round(tp1 / o1, 6) END AS hold_accuracy, CASE WHEN fine AND o2 > 0 THEN round(tp2 / o2, 6) END AS buy_accuracy,
  CASE WHEN fine AND n_calls > 10 AND n_moved > 0 THEN round(n_right / n_moved, 6) END AS directional_accuracy, CASE WHEN fine AND n_calls > 10 THEN n_moved ELSE 0 END AS n_directional,
  CASE WHEN fine THEN n_trades END AS n_trades, CASE WHEN fine AND trades THEN round(mean / dev * sqrt(252), 6) END AS sharpe, CASE WHEN fine AND trades THEN round(mean * 252, 6) END AS ann_return,
  CASE WHEN fine AND trades THEN round(wins / n_trades, 6) END AS win_rate, CASE WHEN fine THEN round(mean_confidence, 6) END AS mean_confidence FROM limits l LEFT JOIN f USING (threshold))
"""


def _sweep(spark, sf):
    out = M.confidence_sweep(S.predictions(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double" and c != "threshold"})


@query(SWEEP + "SELECT * FROM sweep")
def confidence_sweep(spark, sf):
    return _sweep(spark, sf)


#: The two-sided p-value of a correlation r of n pairs: the finite series of Student's
#: distribution, with the sine |r| and the cosine sqrt(1 - r^2), term by term.
STUDENT = """series AS (
  SELECT k, n, abs(r) AS s, sqrt(1 - r * r) AS c, (n - 2) % 2 AS odd, 0 AS j, CASE WHEN (n - 2) % 2 = 0 THEN 1.0::DOUBLE WHEN n = 3 THEN 0.0::DOUBLE ELSE sqrt(1 - r * r) END AS term, CASE WHEN (n - 2) % 2 = 0 THEN 1.0::DOUBLE WHEN n = 3 THEN 0.0::DOUBLE ELSE sqrt(1 - r * r) END AS total
  FROM given WHERE n >= 3 AND abs(r) < 1
  UNION ALL
  SELECT k, n, s, c, odd, j + 1, term * c * c * (2 * (j + 1) - 1 + odd) / (2 * (j + 1) + odd), total + term * c * c * (2 * (j + 1) - 1 + odd) / (2 * (j + 1) + odd) FROM series WHERE j + 1 <= (n - 4 - odd) // 2),
ends AS (SELECT k, CASE WHEN odd = 0 THEN 1 - s * total ELSE 1 - 2 / pi() * (asin(s) + s * total) END AS p FROM series WHERE j = greatest(0, (n - 4 - odd) // 2)),
tested AS (SELECT k, n, r, CASE WHEN r IS NULL OR n < 3 OR r = 0 THEN 1.0 WHEN abs(r) >= 1 THEN 0.0 ELSE p END AS p FROM given LEFT JOIN ends USING (k))"""
ICS = """own AS (SELECT threshold, rank() OVER (PARTITION BY threshold ORDER BY p_buy - p_sell) + (count(*) OVER (PARTITION BY threshold, p_buy - p_sell) - 1) / 2 AS a,
  rank() OVER (PARTITION BY threshold ORDER BY ret) + (count(*) OVER (PARTITION BY threshold, ret) - 1) / 2 AS b FROM limits, predictions WHERE conf >= threshold AND ret IS NOT NULL),
given AS (SELECT threshold AS k, count(*) AS n, coalesce(corr(a, b), 0) AS r FROM own GROUP BY threshold)"""


@query(SWEEP.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {ICS}, {STUDENT}
SELECT 'ic' AS objective, arg_max(t.k, (round(r, 6), -t.k)) AS threshold, max(round(r, 6)) AS value FROM tested t JOIN sweep ON t.k = threshold WHERE status = 'ok' AND p < 0.05 HAVING count(*) > 0
UNION ALL SELECT 'sharpe' AS objective, arg_max(threshold, (sharpe, -threshold)) AS threshold, max(sharpe) AS value FROM sweep WHERE status = 'ok' AND n_trades >= 100 AND sharpe IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'accuracy', arg_max(threshold, (accuracy, -threshold)), max(accuracy) FROM sweep WHERE status = 'ok' AND n_samples >= 500 AND accuracy IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'directional_accuracy', arg_max(threshold, (directional_accuracy, -threshold)), max(directional_accuracy) FROM sweep WHERE status = 'ok' AND n_directional >= 100 AND directional_accuracy IS NOT NULL HAVING count(*) > 0""")
def best_thresholds(spark, sf):
    out = M.sweep_with_ic(S.predictions(spark, sf))
    return M.best_thresholds(out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double" and c != "threshold"}))


@query(PRED + """, models AS (SELECT id, p_sell, p_hold, p_buy FROM predictions UNION ALL SELECT id, p_hold, p_buy, p_sell FROM predictions UNION ALL SELECT id, 0.2, 0.3, 0.5 FROM predictions),
e AS (SELECT id, avg(p_sell) AS p_sell, avg(p_hold) AS p_hold, avg(p_buy) AS p_buy, count(*) AS n_models FROM models GROUP BY id),
r AS (SELECT id, round(p_sell, 9) AS p_sell, round(p_hold, 9) AS p_hold, round(p_buy, 9) AS p_buy, n_models FROM e)
SELECT id, p_sell, p_hold, p_buy, n_models, CASE WHEN p_sell >= greatest(p_hold, p_buy) THEN 0 WHEN p_hold >= p_buy THEN 1 ELSE 2 END AS pred FROM r""")
def ensemble_average(spark, sf):
    p = S.predictions(spark, sf)
    models = p.select("id", "p_sell", "p_hold", "p_buy").unionByName(p.select("id", F.col("p_hold").alias("p_sell"), F.col("p_buy").alias("p_hold"), F.col("p_sell").alias("p_buy")))
    models = models.unionByName(p.select("id", F.lit(0.2).alias("p_sell"), F.lit(0.3).alias("p_hold"), F.lit(0.5).alias("p_buy")))
    return M.ensemble(models).withColumns({c: F.round(c, 9) for c in ("p_sell", "p_hold", "p_buy")})


@query(PRED + " SELECT quantile_cont(conf, 0.25) AS conf_p25, quantile_cont(conf, 0.5) AS conf_p50, quantile_cont(conf, 0.75) AS conf_p75 FROM predictions")
def confidence_quantiles(spark, sf):
    return M.quantiles(S.predictions(spark, sf))


@query(PRED.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {RANKED}, ic AS (SELECT count(*) AS n, coalesce(corr(a, b), 0) AS ic FROM ranked),
d AS (SELECT count(*) FILTER (CASE WHEN pred = 2 THEN ret > 0 ELSE ret < 0 END) / count(*) AS directional_accuracy, count(*) AS n_directional FROM predictions WHERE ret IS NOT NULL AND pred <> 1 AND ret <> 0),
v AS (SELECT *, row_number() OVER (ORDER BY conf DESC, id) AS k, count(*) OVER () AS n FROM predictions WHERE ret IS NOT NULL),
t AS (SELECT CASE pred WHEN 2 THEN ret - 0.001 WHEN 0 THEN -ret - 0.001 ELSE 0 END AS r FROM v WHERE k <= greatest(1, CAST(trunc(0.3 * n) AS BIGINT))),
top AS (SELECT count(*) AS n_top_trades, avg(r) / stddev_pop(r) * sqrt(252) AS sharpe_top, avg(r) * 252 AS return_top FROM t),
precise AS (SELECT count(*) AS n_high_confidence, CASE WHEN count(*) >= 10 THEN count(*) FILTER (pred = label) / count(*) END AS precision_at_confidence FROM predictions WHERE ret IS NOT NULL AND conf > 0.6)
, given AS (SELECT 1 AS k, n, ic AS r FROM ic), {STUDENT}
SELECT ic.n, round(ic, 6) AS ic, round(p.p, 6) AS ic_pvalue, round(directional_accuracy, 6) AS directional_accuracy, n_directional, n_top_trades, round(sharpe_top, 6) AS sharpe_top, round(return_top, 6) AS return_top, n_high_confidence, round(precision_at_confidence, 6) AS precision_at_confidence FROM ic, d, top, precise, tested AS p""")
def trading_report(spark, sf):
    """All trading metrics in one row."""
    out = M.trading_report(S.predictions(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@query(SWEEP.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {ICS}, {STUDENT}
SELECT threshold, n_samples, status, round(coalesce(r, 0), 6) AS ic, round(coalesce(p, 1), 6) AS ic_pvalue, coalesce(p, 1) < 0.05 AS ic_significant FROM sweep LEFT JOIN tested ON k = threshold""")
def sweep_with_ic(spark, sf):
    """The coefficient per threshold and whether it is significant."""
    out = M.sweep_with_ic(S.predictions(spark, sf))
    return out.select("threshold", "n_samples", "status", F.round("ic", 6).alias("ic"), F.round("ic_pvalue", 6).alias("ic_pvalue"), "ic_significant")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, * FROM orders)
SELECT count(*) AS n_rows, count(DISTINCT o_orderpriority) AS n_tickers, count(DISTINCT o_custkey % 50) AS n_authors, true AS n_tweets_within_2_percent, min(o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS INTEGER))) AS first_ts, max(o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS INTEGER))) AS last_ts
FROM d WHERE day >= DATE '1996-01-01' AND day <= DATE '1999-12-31'""")
def table_stats_of_days(spark, sf):
    """Statistics of a range of days from stored sketches, which two syncs have merged."""
    t = S.tweets(spark, sf)
    store = Store(spark, scratch_path(spark, "sketches"), ["day"], 4)
    for number, rows in enumerate((t.where("id % 3 <> 0"), t.where("id % 3 = 0"))):
        store.merge(ST.daily_sketches(rows), ST.merged_sketches, batch=("sync", number))
    since, until = date(1996, 1, 1), date(1999, 12, 31)
    exact = t.where((F.col("ts") >= F.lit(since)) & (F.col("ts") < F.lit(date(2000, 1, 1)))).agg(F.count_distinct("id").alias("exact"))
    out = ST.sketched_stats(store.read(), since, until).join(exact)  # one row each
    return out.withColumn("n_tweets_within_2_percent", F.abs(F.col("n_tweets") - F.col("exact")) <= 0.02 * F.col("exact")).drop("n_tweets", "exact")


@query(f"""WITH {S.TWEETS} SELECT ticker, min(ts) AS first_ts, max(ts) AS last_ts FROM tweets GROUP BY ticker""")
def ticker_date_range(spark, sf):
    return S.tweets(spark, sf).groupBy("ticker").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""WITH {S.TWEETS} SELECT count(*) AS n_rows, count(DISTINCT id) AS n_tweets, count(DISTINCT ticker) AS n_tickers, count(DISTINCT author) AS n_authors, min(ts) AS first_ts, max(ts) AS last_ts FROM tweets""")
def table_stats(spark, sf):
    return ST.table_stats(S.tweets(spark, sf))


@query(f"""WITH {S.TWEETS} SELECT id, ts, ticker, author, text FROM tweets WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1996-12-31' AND ticker = '2-HIGH'""")
def tweet_selection(spark, sf):
    from datetime import datetime

    return ST.selected(S.tweets(spark, sf), datetime(1996, 1, 1), datetime(1996, 12, 31), ticker="2-HIGH")


def _journal(spark, sf):
    e = S.table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("account"), F.col("ts").cast("date").alias("fetch_date")).agg(F.max("ts").alias("fetched_at"), F.count("*").alias("tweets_count"))


JOURNAL = "journal AS (SELECT user_id AS account, CAST(ts AS DATE) AS fetch_date, max(ts) AS fetched_at, count(*) AS tweets_count FROM events GROUP BY 1, 2)"


@query(f"""WITH {JOURNAL}, g AS (SELECT account, fetch_date, lag(fetch_date) OVER (PARTITION BY account ORDER BY fetch_date) AS prev_date FROM journal)
SELECT account, prev_date, fetch_date, CAST(fetch_date - prev_date AS INTEGER) AS gap_days FROM g WHERE fetch_date - prev_date > 2""")
def journal_gaps(spark, sf):
    return ST.journal_gaps(_journal(spark, sf))


@query(f"WITH {JOURNAL} SELECT account, count(*) AS n_days, CAST(sum(tweets_count) AS BIGINT) AS n_tweets, min(fetch_date) AS first_day, max(fetch_date) AS last_day FROM journal GROUP BY account")
def journal_summary(spark, sf):
    return ST.journal_summary(_journal(spark, sf))


@query(f"""WITH {JOURNAL}, days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-19', INTERVAL 1 DAY)) AS DATE) AS fetch_date)
SELECT account, fetch_date FROM (SELECT DISTINCT account FROM journal), days WHERE (account, fetch_date) NOT IN (SELECT account, fetch_date FROM journal)""")
def days_to_fetch(spark, sf):
    j = _journal(spark, sf)
    return ST.days_to_fetch(j.select("account").distinct(), j, F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 20)))


@query("""WITH e AS (SELECT event_id AS id, event_type AS account, ts FROM events), stored AS (SELECT * FROM e WHERE id < 5000),
arriving AS (SELECT * FROM e WHERE id >= 4000 UNION ALL SELECT * FROM e WHERE id >= 4500)
SELECT * FROM stored UNION ALL SELECT DISTINCT * FROM arriving WHERE id NOT IN (SELECT id FROM stored)""")
def insert_if_absent(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("account"), "ts")
    return ST.insert_new(e.where("id < 5000"), e.where("id >= 4000").unionByName(e.where("id >= 4500")), ["id"])


@query("""WITH old AS (SELECT event_type AS account, max(event_id) AS last_tweet_id, min(event_id) AS last_cursor, count(*) AS total_tweets FROM events WHERE event_id < 5000 AND event_type <> 'view' GROUP BY 1),
new AS (SELECT event_type AS account, CASE WHEN event_type <> 'click' THEN max(event_id) END AS last_tweet_id, min(event_id) AS last_cursor, count(*) AS total_tweets FROM events WHERE event_id >= 5000 AND event_type <> 'purchase' GROUP BY 1)
SELECT account, coalesce(n.last_tweet_id, o.last_tweet_id) AS last_tweet_id, CASE WHEN n.account IS NOT NULL THEN n.last_cursor ELSE o.last_cursor END AS last_cursor,
  coalesce(o.total_tweets, 0) + coalesce(n.total_tweets, 0) AS total_tweets FROM (SELECT account FROM old UNION SELECT account FROM new) LEFT JOIN old o USING (account) LEFT JOIN new n USING (account)""")
def upsert_state(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("event_type").alias("account"), "event_id")
    agg = lambda d: d.groupBy("account").agg(F.max("event_id").alias("last_tweet_id"), F.min("event_id").alias("last_cursor"), F.count("*").alias("total_tweets"))
    new = agg(e.where("event_id >= 5000 and account <> 'purchase'")).withColumn("last_tweet_id", F.when(F.col("account") != "click", F.col("last_tweet_id")))
    return ST.upsert_state(agg(e.where("event_id < 5000 and account <> 'view'")), new)


@query(f"""WITH {S.TWEETS}, n AS (SELECT author, count(*) AS n FROM tweets GROUP BY author), k AS (SELECT author, n, row_number() OVER (ORDER BY n DESC, author) AS rank, n / sum(n) OVER () AS share FROM n)
SELECT author, n, CAST(rank AS INTEGER) AS rank, round(sum(share) OVER (ORDER BY rank), 6) AS cumulative_share FROM k WHERE rank <= 10""")
def author_concentration(spark, sf):
    return ST.concentration(S.tweets(spark, sf), "author").withColumn("cumulative_share", F.round("cumulative_share", 6))


@query("""SELECT round(avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END), 6) AS missing_quality, round(avg(CASE WHEN d.text IS NULL OR d.text = '' THEN 1.0 ELSE 0 END), 6) AS empty_text,
round(avg(length(d.text)), 6) AS avg_chars, count(*) AS n FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)""")
def missing_rates(spark, sf):
    l = S.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = S.table(spark, sf, "documents").join(l, "doc_id", "left")
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return d.agg(rate(F.col("quality").isNull()).alias("missing_quality"), rate(F.coalesce(F.col("text") == "", F.lit(True))).alias("empty_text"), F.round(F.avg(F.char_length("text")), 6).alias("avg_chars"), F.count("*").alias("n"))


@query(f"""WITH RECURSIVE given AS (SELECT label AS k, count(*) AS n, corr(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS r FROM embeddings GROUP BY label), {STUDENT}
SELECT k AS label, n, round(r, 6) AS r, round(p, 6) AS p FROM tested""")
def student_p_values(spark, sf):
    """The correlation of two numbers of each label's vectors, and its p-value."""
    e = S.table(spark, sf, "embeddings").select("label", *[F.get("embedding", F.lit(k)).cast("double").alias(f"x{k}") for k in (0, 1)])
    out = e.groupBy("label").agg(F.count("*").alias("n"), correlation("x0", "x1").alias("r"))
    return out.select("label", "n", F.round("r", 6).alias("r"), F.round(correlation_p(F.col("r"), F.col("n")), 6).alias("p"))


@query("""SELECT event_id, ts, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, props IS NULL AS missing FROM events""")
def json_projection(spark, sf):
    e = S.table(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    return e.select("event_id", "ts", F.coalesce("p.k", F.lit(0)).alias("k"), F.col("props").isNull().alias("missing"))


@query("""SELECT event_id, strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') AS api, ts AS instant FROM events""")
def api_timestamps(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("api"), F.col("ts"))
    return e.select("event_id", "api", (Z.api_time(F.col("api")) + (F.col("ts").cast("timestamp") - F.date_trunc("second", F.col("ts").cast("timestamp")))).cast("timestamp_ntz").alias("instant"))


@query("""WITH j AS (SELECT user_id AS account, CAST(ts AS DATE) AS fetch_date, ts AS fetched_at, event_id AS tweets_count FROM events)
SELECT account, fetch_date, fetched_at, tweets_count FROM (SELECT *, row_number() OVER (PARTITION BY account, fetch_date ORDER BY fetched_at DESC, tweets_count DESC) AS k FROM j) WHERE k = 1""")
def journal_latest(spark, sf):
    e = S.table(spark, sf, "events")
    return ST.latest_journal(e.select(F.col("user_id").alias("account"), F.col("ts").cast("date").alias("fetch_date"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("tweets_count")))


@query(f"""WITH {JOURNAL}, accounts AS (SELECT DISTINCT account FROM journal UNION SELECT -1), raw AS (SELECT user_id AS account, count(*) AS n_raw FROM events GROUP BY 1),
days AS (SELECT account, count(DISTINCT fetch_date) AS n_days FROM journal GROUP BY 1), state AS (SELECT account, CAST(sum(tweets_count) AS BIGINT) AS total_tweets FROM journal GROUP BY 1)
SELECT account, coalesce(total_tweets, 0) AS total_tweets, coalesce(n_raw, 0) AS n_raw, coalesce(n_days, 0) AS n_days FROM accounts LEFT JOIN state USING (account) LEFT JOIN raw USING (account) LEFT JOIN days USING (account)""")
def status_report(spark, sf):
    j = _journal(spark, sf)
    accounts = j.select("account").distinct().union(spark.createDataFrame([(-1,)], "account long"))
    state = j.groupBy("account").agg(F.sum("tweets_count").alias("total_tweets"))
    return ST.status_report(accounts, state, S.table(spark, sf, "events").select(F.col("user_id").alias("account")), j)


@query("""WITH l AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'SELL' WHEN 1 THEN 'HOLD' ELSE 'BUY' END AS c, doc_id % 4 <> 0 AS ok FROM documents), n AS (SELECT c, count(*) AS n FROM l GROUP BY c)
SELECT 'largest_class' AS "check", round((SELECT max(n) / sum(n) FROM n), 6) AS value, (SELECT max(n) / sum(n) FROM n) < 0.7 AS passed
UNION ALL SELECT 'has_label', 1.0, true UNION ALL SELECT 'reliable', round((SELECT avg(ok::INT) FROM l), 6), (SELECT avg(ok::INT) FROM l) > 0.5""")
def phase_zero(spark, sf):
    from ..operators.validate import phase_zero as checks

    k = F.col("doc_id") % 3
    df = S.table(spark, sf, "documents").select(F.when(k == 0, "SELL").when(k == 1, "HOLD").otherwise("BUY").alias("label_1d_3class"), (F.col("doc_id") % 4 != 0).alias("is_reliable_label"))
    return checks(df).withColumn("value", F.round("value", 6))
