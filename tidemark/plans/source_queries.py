"""Queries over round trips through files, times, texts and reports, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timezones as Z
from ..operators import metrics as M
from ..operators import prep as P
from ..operators import state as ST
from ..operators import validate as V
from ..operators.indicators import with_indicators
from ..scratch import scratch_path
from ..sources import raw, sinks
from ..sources import tables as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


MADE = """made AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)"""


@query(f"""WITH {MADE} SELECT CAST(doc_id AS VARCHAR) AS id, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS ts, 'Name ' || source AS author, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS username,
CASE doc_id % 4 WHEN 0 THEN 'https://x.com/t/' || doc_id WHEN 1 THEN 'https://u/' || doc_id WHEN 2 THEN 'https://u/' || doc_id ELSE '' END AS url, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source || ' ' || doc_id END AS symbols, text FROM made""")
def tweet_json(spark, sf):
    """Nested JSON of the API, some of it missing, to flat tweets."""
    d = S.table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    i, k = F.col("doc_id"), lambda n: F.col("doc_id") % n
    symbol = lambda x: F.struct(x.alias("text"))
    body = F.struct(
        i.cast("string").alias("id"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + i), "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("createdAt"),
        F.struct(F.concat(F.lit("Name "), "source").alias("name"), F.when(k(3) != 0, F.col("source")).alias("userName")).alias("author"),
        F.when(k(4) == 0, F.concat(F.lit("https://x.com/t/"), i.cast("string"))).when(k(4) == 1, "").alias("twitterUrl"),
        F.when(k(4) != 3, F.concat(F.lit("https://u/"), i.cast("string"))).alias("url"),
        F.when(k(5) != 0, F.struct(F.array(symbol(F.col("source")), symbol(i.cast("string"))).alias("symbols"))).alias("entities"),
        F.col("text"),
    )
    out = raw.parse_json(d.select(F.to_json(body).alias("json_data")))
    return out.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "symbols": F.array_join("symbols", " ")})


@query(f"""WITH {S.DAILY} SELECT symbol, bar_date, open, high, low, close, CAST(volume AS DOUBLE) AS volume FROM daily WHERE symbol IN ('1-URGENT', '5-LOW')""")
def bar_store(spark, sf):
    """Bars written by symbol and read again for the symbols that a table asks for."""
    path = scratch_path(spark, "bars")
    sinks.write_bars(S.daily_bars(spark, sf).withColumn("volume", F.col("volume").cast("double")), path)
    wanted = spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("none",)], "symbol string")
    return raw.bars_of_symbols(raw.read_bars(spark, path), wanted).select("symbol", "bar_date", "open", "high", "low", "close", "volume")


@query(f"WITH {S.DAILY} SELECT symbol, count(*) AS n_bars, min(bar_date) AS first_bar, max(bar_date) AS last_bar FROM daily GROUP BY symbol")
def store_stats(spark, sf):
    return raw.store_stats(S.daily_bars(spark, sf))


@query(f"""WITH {S.TWEETS} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, author, ticker, 'https://x.com/' || id AS tweet_url, 'Other' AS category, text FROM tweets WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01'""")
def csv_export(spark, sf):
    """Processed tweets to CSV files and back."""
    rows = S.tweets(spark, sf).where("ts >= '1996-01-01' and ts < '1997-01-01'").withColumns({"tweet_url": F.concat(F.lit("https://x.com/"), F.col("id").cast("string")), "category": F.lit("Other")})
    path = scratch_path(spark, "export")
    sinks.export_csv(rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, text, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id / 8.0::DOUBLE END AS value FROM documents""")
def dataset_roundtrip(spark, sf):
    """A dataset with texts of many lines as CSV, and read with the types it was written with."""
    df = S.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") / 8).alias("value"))
    path = scratch_path(spark, "dataset") + ".csv"
    sinks.write_dataset(df, path)
    return raw.read_csv(spark, path, "id string, text string, value double")


@query(f"WITH {S.PREDICTIONS}, c AS (SELECT label, count(*) AS n FROM predictions GROUP BY 1) SELECT CAST(label AS INTEGER) AS label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def artifact_roundtrip(spark, sf):
    path = scratch_path(spark, "artifacts")
    sinks.save_artifacts({"weights": P.class_weights(S.predictions(spark, sf))}, path)
    return sinks.load_artifact(spark, path, "weights", "label int, n long, weight double").withColumn("weight", F.round("weight", 6))


@query(f"WITH {S.PREDICTIONS}, r AS (SELECT count(*) AS n, round(avg((pred = label)::INT), 6) AS accuracy FROM predictions) SELECT n, accuracy FROM r")
def results_json(spark, sf):
    """The evaluation as one JSON object in a file."""
    path = scratch_path(spark, "results")
    sinks.write_results({"scores": M.scores(S.predictions(spark, sf))}, path)
    return spark.read.json(path).select(F.explode("scores").alias("s")).select("s.n", F.round("s.accuracy", 6).alias("accuracy"))


#: Arrows, forms that fold, dashes, zero-width signs, emoji, a flag's half and signs that go.
SIGNS = " \u2191\u2b07 \ufb01\u2460\uff21\uff22\u2014x\u2026 \u2022\u2461\u200b\u2192\U0001f680\ufe0f\U0001f525\U0001f1fa\u2603\u25aa z"


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, '') || ' [up][down] fi1AB - x... - 2 [rocket] [fire] z', ' {2,}', ' ', 'g'), '^\s+', '') AS clean FROM documents""")
def clean_signs(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", X.clean_for_model(F.concat(F.coalesce("text", F.lit("")), F.lit(SIGNS))).alias("clean"))


@query(r"""WITH n AS (SELECT doc_id, text, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Za-z\x{aa}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]', '', 'g')) AS latin FROM documents)
SELECT doc_id, coalesce(length(text) >= 60 AND (letters = 0 OR (letters - latin) / letters < 0.2), false) AS is_valid FROM n""")
def text_is_valid(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", X.is_valid(F.col("text")).alias("is_valid"))


#: Each event at its own time, and in the hours that clocks skipped and repeated that year.
WALLS = """walls AS (SELECT event_id, unnest([ts, TIMESTAMP '2024-03-10 02:00:00' + to_microseconds(epoch_us(ts) % 3600000000), TIMESTAMP '2024-11-03 01:00:00' + to_microseconds(epoch_us(ts) % 3600000000)]) AS wall FROM events)"""


@query(f"""WITH {WALLS}, z AS (SELECT *, wall >= TIMESTAMP '2024-03-10 02:00:00' AND wall < TIMESTAMP '2024-03-10 03:00:00' AS skipped, wall >= TIMESTAMP '2024-11-03 01:00:00' AND wall < TIMESTAMP '2024-11-03 02:00:00' AS twice FROM walls)
SELECT event_id, wall, CASE WHEN skipped THEN TIMESTAMP '2024-03-10 07:00:00' ELSE timezone('UTC', timezone('America/New_York', wall)) END AS bar_ts FROM z WHERE NOT twice""")
def bars_to_instants(spark, sf):
    """Bars from wall clock to instants: the skipped hour moves to its end, the repeated one goes."""
    part = F.make_dt_interval(secs=(F.unix_micros(F.col("ts").cast("timestamp")) % 3_600_000_000) / 1_000_000)
    walls = F.array("ts", *[(F.lit(t).cast("timestamp_ntz") + part).cast("timestamp_ntz") for t in ("2024-03-10 02:00:00", "2024-11-03 01:00:00")])
    rows = S.table(spark, sf, "events").select("event_id", F.explode(walls).alias("wall")).withColumn("bar_ts", F.col("wall"))
    return Z.normalized_bars(rows).select("event_id", "wall", F.col("bar_ts").cast("timestamp_ntz").alias("bar_ts"))


@query("SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS eastern FROM events")
def utc_to_eastern(spark, sf):
    return S.table(spark, sf, "events").select("event_id", Z.to_eastern(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("eastern"))


@query("""WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts FROM events), z AS (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS local FROM e)
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'soon' ELSE strftime(local, '%Y-%m-%d %H:%M:%S') || CASE WHEN date_diff('hour', local, ts) = 4 THEN '-0400' ELSE '-0500' END END AS eastern FROM z""")
def api_to_eastern_text(spark, sf):
    """API times as New York text with its offset; what can't be read stays."""
    api = F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    return S.table(spark, sf, "events").select("event_id", Z.eastern_text(F.when(F.col("event_id") % 9 == 0, F.lit("soon")).otherwise(api)).alias("eastern"))


@query("""WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts + INTERVAL 5 HOUR WHEN 3 THEN NULL WHEN 2 THEN ts - INTERVAL 2 HOUR ELSE ts END AS instant FROM e""")
def stored_times(spark, sf):
    """Stored text with an offset, without one, in ISO form, and none."""
    k = F.col("event_id") % 4
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(k == 0, F.concat(plain, F.lit("-0500"))).when(k == 1, plain).when(k == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise("?")
    return S.table(spark, sf, "events").select("event_id", Z.stored_time(text).cast("timestamp_ntz").alias("instant"))


def _rows(spark, sf) -> DataFrame:
    """Documents as rows of a dataset: labels by id, some missing, some unreliable."""
    k = F.col("doc_id")
    label = F.when(k % 5 == 4, None).when(k % 3 == 0, "SELL").when(k % 3 == 1, "HOLD").otherwise("BUY")
    return S.table(spark, sf, "documents").select("doc_id", F.col("source").alias("author"), F.col("lang").alias("ticker"), "text", label.alias("label_1d_3class"), (k % 4 != 0).alias("is_reliable_label"), F.when(k % 6 != 0, k / 8).alias("rsi_14"), F.lit(None).cast("double").alias("volatility_7d"))


ROWS = """rows AS (SELECT doc_id, source AS author, lang AS ticker, text, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 3 = 0 THEN 'SELL' WHEN doc_id % 3 = 1 THEN 'HOLD' ELSE 'BUY' END AS label_1d_3class,
  doc_id % 4 <> 0 AS is_reliable_label, CASE WHEN doc_id % 6 <> 0 THEN doc_id / 8.0::DOUBLE END AS rsi_14, NULL::DOUBLE AS volatility_7d FROM documents)"""


@query(f"WITH {ROWS} SELECT doc_id, CASE label_1d_3class WHEN 'SELL' THEN 0 WHEN 'HOLD' THEN 1 ELSE 2 END AS label FROM rows WHERE is_reliable_label AND label_1d_3class IS NOT NULL")
def reliable_labels(spark, sf):
    """Reliable rows with a target, and the labels' numbers."""
    return P.reliable_rows(_rows(spark, sf)).select("doc_id", P.label_id(F.col("label_1d_3class")).alias("label"))


@query(f"WITH {ROWS} SELECT doc_id FROM rows WHERE label_1d_3class IS NOT NULL AND length(text) > 0")
def labelled_texts(spark, sf):
    return P.labelled_texts(_rows(spark, sf)).select("doc_id")


@query(f"WITH {ROWS} SELECT doc_id, coalesce(rsi_14, 0) AS rsi_14, coalesce(volatility_7d, 0) AS volatility_7d FROM rows")
def feature_columns(spark, sf):
    """Missing numbers as 0; a column that sees the future is refused (tested in pytest)."""
    return P.feature_columns(_rows(spark, sf), ["rsi_14", "volatility_7d"], ["ticker"]).select("doc_id", "rsi_14", "volatility_7d")


@query(f"""WITH {ROWS} SELECT count(*) AS total_samples, count(*) FILTER (is_reliable_label) AS reliable_samples, count(*) FILTER (label_1d_3class = 'SELL') AS n_sell, count(*) FILTER (label_1d_3class = 'HOLD') AS n_hold,
count(*) FILTER (label_1d_3class = 'BUY') AS n_buy, count(*) FILTER (label_1d_3class IS NULL) AS missing_target, count(DISTINCT author) AS unique_authors, count(DISTINCT ticker) AS unique_tickers FROM rows""")
def data_summary(spark, sf):
    return P.summary(_rows(spark, sf))


@query(f"""WITH {ROWS} SELECT 'rsi_14' AS feature, round(avg((rsi_14 IS NULL)::INT), 6) AS missing_rate FROM rows UNION ALL SELECT 'volatility_7d', 1.0 UNION ALL SELECT 'text', round(avg((text IS NULL)::INT), 6) FROM rows
UNION ALL SELECT 'label_1d_3class', round(avg((label_1d_3class IS NULL)::INT), 6) FROM rows""")
def missing_by_feature(spark, sf):
    return P.missing_shares(_rows(spark, sf), ["rsi_14", "volatility_7d", "text", "label_1d_3class"]).withColumn("missing_rate", F.round("missing_rate", 6))


@query(f"""WITH {ROWS}, l AS (SELECT * FROM rows WHERE label_1d_3class IS NOT NULL), n AS (SELECT author, count(*) AS n, avg((label_1d_3class = 'SELL')::INT) AS s, avg((label_1d_3class = 'HOLD')::INT) AS h, avg((label_1d_3class = 'BUY')::INT) AS b FROM l GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, author) AS rank, n / sum(n) OVER () AS share FROM n)
SELECT author, n, CAST(rank AS INTEGER) AS rank, round(sum(share) OVER (ORDER BY rank), 6) AS cumulative_share, round(s, 6) AS share_sell, round(h, 6) AS share_hold, round(b, 6) AS share_buy FROM k WHERE rank <= 5""")
def author_labels(spark, sf):
    """The label mix of the authors with the most rows."""
    out = ST.concentration(_rows(spark, sf).where("label_1d_3class is not null"), "author", F.col("label_1d_3class"), 5)
    return out.select("author", "n", "rank", *[F.round(c, 6).alias(c) for c in ("cumulative_share", "share_sell", "share_hold", "share_buy")])


@query("""WITH r AS (SELECT n_nationkey AS a, CASE WHEN n_nationkey % 6 = 5 THEN 'failed' END AS error FROM nation)
SELECT count(*) AS n_accounts, count(error) AS n_failed, sum(10 * a) FILTER (error IS NULL)::BIGINT AS n_raw, sum(a) FILTER (error IS NULL)::BIGINT AS n_processed, sum(2) FILTER (error IS NULL)::BIGINT AS api_calls FROM r""")
def sync_totals(spark, sf):
    k = F.col("n_nationkey")
    return ST.sync_totals(S.table(spark, sf, "nation").select(k.alias("account"), (10 * k).alias("n_raw"), k.alias("n_processed"), F.lit(2).alias("api_calls"), F.when(k % 6 == 5, "failed").alias("error")))


@query("""WITH old AS (SELECT n_name AS account, 'c' || n_nationkey AS cursor, DATE '2024-01-01' + n_nationkey::INTEGER AS target_date, false AS complete FROM nation WHERE n_nationkey < 15),
new AS (SELECT n_name AS account, CASE WHEN n_nationkey % 2 = 0 THEN 'd' || n_nationkey END AS cursor, CASE WHEN n_nationkey % 3 = 0 THEN DATE '2023-01-01' END AS target_date, n_nationkey % 4 = 0 AS complete FROM nation WHERE n_nationkey >= 10)
SELECT account, CASE WHEN n.account IS NOT NULL THEN n.cursor ELSE o.cursor END AS cursor, coalesce(n.target_date, o.target_date) AS target_date, coalesce(n.complete, o.complete) AS complete
FROM (SELECT n_name AS account FROM nation) LEFT JOIN old o USING (account) LEFT JOIN new n USING (account)""")
def upsert_backfill(spark, sf):
    n, k = S.table(spark, sf, "nation"), F.col("n_nationkey")
    text = k.cast("string")
    old = n.where(k < 15).select(F.col("n_name").alias("account"), F.concat(F.lit("c"), text).alias("cursor"), F.date_add(F.lit(date(2024, 1, 1)), k.cast("int")).alias("target_date"), F.lit(False).alias("complete"))
    new = n.where(k >= 10).select(F.col("n_name").alias("account"), F.when(k % 2 == 0, F.concat(F.lit("d"), text)).alias("cursor"), F.when(k % 3 == 0, F.lit(date(2023, 1, 1))).alias("target_date"), (k % 4 == 0).alias("complete"))
    return ST.upsert_backfill(old, new)


@query("""WITH j AS (SELECT user_id AS account, CAST(ts AS DATE) AS fetch_date, count(*) AS tweets_count FROM events GROUP BY 1, 2)
SELECT * FROM j ORDER BY fetch_date DESC, account LIMIT 20""")
def journal_newest(spark, sf):
    j = S.table(spark, sf, "events").groupBy(F.col("user_id").alias("account"), F.col("ts").cast("date").alias("fetch_date")).agg(F.count("*").alias("tweets_count"))
    return ST.newest_journal(j)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def random_sample(spark, sf):
    """A sample of 100 rows that a seed decides."""
    return ST.sampled(S.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


@query("""WITH n AS (SELECT count(DISTINCT user_id) AS accounts, count(DISTINCT CAST(ts AS DATE)) AS days FROM events)
SELECT accounts, days, accounts * days * 30 AS tweets, greatest(1, accounts * days * 30 // 20) AS calls, greatest(1, accounts * days * 30 // 20) * 0.2::DOUBLE AS seconds FROM n""")
def ingest_estimate(spark, sf):
    """What fetching all accounts of events over all their days would take."""
    return ST.estimated(S.table(spark, sf, "events"), "user_id", F.col("ts").cast("date"))


GAINS = """, b AS (SELECT label, count(*) / sum(count(*)) OVER () AS p FROM predictions GROUP BY label), a AS (SELECT avg((pred = label)::INT) AS accuracy FROM predictions)
SELECT round(accuracy, 6) AS accuracy, round((accuracy - (SELECT max(p) FROM b)) / (SELECT max(p) FROM b), 6) AS improvement_vs_naive, round((accuracy - (SELECT 1 / count(*) FROM b)) / (SELECT 1 / count(*) FROM b), 6) AS improvement_vs_random FROM a"""


@query(f"WITH {S.PREDICTIONS}{GAINS}")
def improvement_ratios(spark, sf):
    out = M.improvements(S.predictions(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH {S.PREDICTIONS}, models AS (SELECT 'one' AS model, id, p_sell, p_hold, p_buy FROM predictions UNION ALL SELECT 'two', id, p_hold, p_buy, p_sell FROM predictions),
every AS (SELECT * FROM models UNION ALL SELECT 'ensemble', id, avg(p_sell), avg(p_hold), avg(p_buy) FROM models GROUP BY id),
e AS (SELECT model, label, CASE WHEN p_sell >= greatest(p_hold, p_buy) THEN 0 WHEN p_hold >= p_buy THEN 1 ELSE 2 END AS pred FROM every JOIN (SELECT id, label FROM predictions) USING (id))
SELECT model, count(*) AS n, round(avg((pred = label)::INT), 6) AS accuracy FROM e GROUP BY model""")
def ensemble_scores(spark, sf):
    """Two models and their mean against the truth."""
    p = S.predictions(spark, sf)
    one = p.select(F.lit("one").alias("model"), "id", "p_sell", "p_hold", "p_buy")
    two = p.select(F.lit("two").alias("model"), "id", F.col("p_hold").alias("p_sell"), F.col("p_buy").alias("p_hold"), F.col("p_sell").alias("p_buy"))
    return M.ensemble_report(one.unionByName(two), p.select("id", "label", "ret"))["models"].select("model", "n", F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {S.PREDICTIONS} SELECT count(ret) AS n, round(corr(p_buy - p_sell, ret), 6) AS correlation, abs(corr(p_buy - p_sell, ret)) > 0.05 AS signal FROM predictions WHERE ret IS NOT NULL")
def sentiment_correlation(spark, sf):
    p = S.predictions(spark, sf).withColumn("score", F.col("p_buy") - F.col("p_sell"))
    return M.signal_correlation(p).withColumn("correlation", F.round("correlation", 6))


@query(f"""WITH {S.DAILY}, r AS (SELECT symbol, bar_date, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS return_5d FROM daily),
claimed AS (SELECT *, CASE WHEN day(bar_date) = 7 THEN return_5d + 0.5 ELSE return_5d END AS claim FROM r) SELECT 'return_5d' AS indicator, count(*) AS n_rows, count(*) FILTER (abs(claim - return_5d) > 1e-6) AS n_bad FROM claimed""")
def recomputed_indicators(spark, sf):
    """Stored indicators against those computed anew from the bars."""
    fresh = with_indicators(S.daily_bars(spark, sf)).select("symbol", "bar_date", "return_5d")
    stored = fresh.withColumn("return_5d", F.when(F.dayofmonth("bar_date") == 7, F.col("return_5d") + 0.5).otherwise(F.col("return_5d")))
    return V.recomputed(stored, S.daily_bars(spark, sf), ["return_5d"])


@query("""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
SELECT doc_id, array_to_string(list_transform(range(128), lambda k: CASE WHEN 2 * k < length(h) THEN CAST('0x' || substr(h, 2 * k + 1, 2) AS INTEGER) + 1 ELSE 0 END), ' ') AS input_ids,
  array_to_string(list_transform(range(128), lambda k: CASE WHEN 2 * k < length(h) THEN 1 ELSE 0 END), ' ') AS attention_mask FROM h""")
def padded_tokens(spark, sf):
    """Texts as tokens of a byte each (0 is left for padding), cut and padded to 128."""
    d = S.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = P.token_ids(d, lambda texts: [[b + 1 for b in t.encode()] for t in texts], width=128)
    return out.select("doc_id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"), F.array_join(F.col("attention_mask").cast("array<string>"), " ").alias("attention_mask"))
