"""More registered queries: files, topics, stores, streams, catalog look-ups, scalars and plug points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.period import Period
from tidemark.model import Grouping, SeriesRange
from tidemark.operators import catalog, intervals, load, ranges, tabular
from tidemark.operators.reduce import fold_values, reduce
from tidemark.plans import registry
from tidemark.queries import CUT, DURATIONS, FILE_ROWS, ISLANDS, MERGE, PATHS, SIGNALS, T1, T2, T3, arriving, catalog_paths, durations, four, quarter_files, query, sent, series, table
from tidemark.sources import delimited, records, sinks, store
from tidemark.sources.folders import fresh_path
from tidemark.streaming import streams

PART = r"part-[^/]*"


def _numbers(df: DataFrame) -> DataFrame:
    """Values as numbers or texts by their type; the names of Spark's part files left out of paths."""
    kind = F.col("value_type")
    number = F.when(kind != "string", F.col("value").try_cast("double"))
    return df.select(F.regexp_replace("column_path", PART, "part").alias("column_path"), "key", number.alias("number"), F.when(kind == "string", F.col("value")).alias("text"), "value_type")


# Delimited files


@query("""WITH e AS (SELECT event_type, epoch_us(ts) // 1000 AS key, value, event_id, CASE WHEN event_id % 3 > 0 THEN 'n "' || event_id || '", x' END AS note FROM events)
SELECT 'kind=' || event_type || '/part/value' AS column_path, key, value AS number, NULL AS text, 'double' AS value_type FROM e
UNION ALL SELECT 'kind=' || event_type || '/part/event_id', key, CAST(event_id AS DOUBLE), NULL, 'long' FROM e
UNION ALL SELECT 'kind=' || event_type || '/part/note', key, NULL, note, 'string' FROM e WHERE note IS NOT NULL""")
def delimited_with_headers(spark, sf_dir):
    """Files with a header, a type in it, inferred types, quoted and missing cells, in folders."""
    folder, e = fresh_path(spark, "csv"), table(spark, sf_dir, "events")
    note = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit('n "'), F.col("event_id").cast("string"), F.lit('", x')))
    time = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    wide = e.select(F.col("event_type").alias("kind"), time.alias("time"), F.col("value").alias("value:double"), "event_id", note.alias("note"))
    wide.write.partitionBy("kind").option("header", True).option("escape", '"').csv(folder)
    return _numbers(delimited.read_delimited(spark, folder))


@query("""WITH e AS (SELECT epoch_us(ts) // 1000 AS key, event_id, 'n "' || event_id || '",' || chr(10) || chr(10) || '# ' || event_type AS note FROM events)
SELECT 'part/note, "text"' AS column_path, key, NULL AS number, note AS text, 'string' AS value_type FROM e WHERE event_id % 3 > 0
UNION ALL SELECT 'part/event_id', key, CAST(event_id AS DOUBLE), NULL, 'long' FROM e""")
def delimited_quoted_records(spark, sf_dir):
    """Quoted header fields, cells of several lines, quotes and separators in cells (A1, A2)."""
    folder, e = fresh_path(spark, "csv"), series(spark, sf_dir, "event_id", "event_type")
    note = F.concat(F.lit('n "'), F.col("event_id").cast("string"), F.lit('",\n\n# '), "event_type")
    wide = e.select(F.col("key").alias("time"), F.when(F.col("event_id") % 3 > 0, note).alias('note, "text"'), "event_id")
    wide.repartition(max(3, -(-wide.count() // FILE_ROWS))).write.option("header", True).option("escape", '"').csv(folder)
    return _numbers(delimited.read_delimited(spark, folder))


@query("SELECT event_id AS key, 'n:int' AS name, 'int' AS value_type, 'x' || event_id AS text FROM events WHERE event_id % 50 = 0")
def delimited_bad_values(spark, sf_dir):
    """Cells that are none of their column's type (A4)."""
    folder, e = fresh_path(spark, "csv"), table(spark, sf_dir, "events")
    number = F.col("event_id").cast("string")
    e.select(F.col("event_id").alias("time"), F.concat(F.when(F.col("event_id") % 50 == 0, "x").otherwise(""), number).alias("n:int")).write.option("header", True).csv(folder)
    return delimited.bad_values(spark, folder).select("key", F.concat("name", F.lit(":int")).alias("name"), "value_type", "text")


@query("""SELECT 'part/' || n AS column_path, key, number, NULL AS text, 'long' AS value_type FROM (
SELECT epoch_us(ts) // 1000 AS key, CAST(event_id AS DOUBLE) AS number, '2' AS n FROM events UNION ALL SELECT epoch_us(ts) // 1000, CAST(user_id AS DOUBLE), '3' FROM events)""")
def delimited_without_headers(spark, sf_dir):
    folder, e = fresh_path(spark, "tsv"), series(spark, sf_dir, "event_id", "user_id")
    e.select("key", "event_id", "user_id").write.option("sep", "\t").csv(folder)
    return _numbers(delimited.read_delimited(spark, folder))


@query("SELECT 'x' || event_id || ',' || event_id AS line FROM events WHERE event_id % 7 = 0")
def delimited_bad_keys(spark, sf_dir):
    folder, e = fresh_path(spark, "csv"), table(spark, sf_dir, "events")
    number = F.col("event_id").cast("string")
    e.select(F.concat(F.when(F.col("event_id") % 7 == 0, "x").otherwise(""), number).alias("when_date"), "event_id").write.option("header", True).csv(folder)
    return delimited.bad_keys(spark, folder).select("line")


@query("SELECT event_id, CASE user_id % 4 WHEN 0 THEN event_type || '/f' || event_id WHEN 1 THEN event_type WHEN 2 THEN 'f' || event_id ELSE 'default' END AS dataset FROM events")
def dataset_paths(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id").cast("string")
    folder = F.when(F.col("user_id") % 4 < 2, F.concat("event_type", F.lit("/"))).when(F.col("user_id") % 4 == 2, "_in/").otherwise("")
    name = F.concat(F.when(F.col("user_id") % 2 == 1, "_").otherwise(""), F.lit("f"), n, F.lit(".TSV"))
    return e.select("event_id", delimited.dataset_from_path(F.concat(F.lit("file:///root/in/"), folder, name), "/root/in").alias("dataset"))


@query("""SELECT event_id, fields, CASE event_id % 4 WHEN 0 THEN 'startTime' WHEN 1 THEN 'time' WHEN 2 THEN 'b_date' ELSE 'a' END AS key_name, CASE WHEN event_id % 2 = 0 THEN 'boolean' END AS first_type FROM (
SELECT event_id, 3 AS fields FROM events)""")
def header_key_columns(spark, sf_dir):
    """The key column and types of header lines, a header for each event."""
    e = table(spark, sf_dir, "events")
    line = F.element_at(F.array(*map(F.lit, ("a:Bool,startTime,n_time", "a,epoch,time", "a:bool\tb_date\tc", "a,b:blob,c:other"))), (F.col("event_id") % 4 + 1).cast("int"))
    told = delimited.header_columns(line)
    return e.select("event_id", *[c.alias(n) for n, c in told.items()]).select("event_id", F.size("names").alias("fields"), F.get("names", F.col("key_at")).alias("key_name"), F.get("types", F.lit(0)).alias("first_type"))


@query("SELECT 'w/' || n AS column_path, key, number, NULL AS text, n2 AS value_type FROM (SELECT epoch_us(ts) // 1000 AS key, value AS number, 'value' AS n, 'double' AS n2 FROM events UNION ALL SELECT epoch_us(ts) // 1000, CAST(event_id AS DOUBLE), 'event_id', 'long' FROM events)")
def watched_files(spark, sf_dir):
    """Files that come into a folder, read as a stream."""
    folder, e = fresh_path(spark, "watched"), series(spark, sf_dir, "event_id")
    for half in (0, 1):
        own = e.where(F.col("event_id") % 2 == half).select(F.col("key").alias("time"), F.col("value").alias("value:double"), F.col("event_id").alias("event_id:long"))
        own.write.mode("append").option("header", True).csv(folder)
    return _numbers(sent(spark, delimited.stream_delimited(spark, folder, "time,value:double,event_id:long", "w"), "append"))


# Records


@query("""SELECT 'p/' || coalesce('u' || nullif(user_id % 5, 0), 'none') || '/' || n AS column_path, epoch_us(ts) // 1000 AS key, number, kind AS value_type FROM (
SELECT user_id, ts, value AS number, 'value' AS n, 'double' AS kind FROM events UNION ALL SELECT user_id, ts, CAST(event_id AS DOUBLE), 'event_id', 'long' FROM events)""")
def flatten_single_records(spark, sf_dir):
    e = series(spark, sf_dir, "event_id", "user_id", "event_type")
    rows = e.select(F.concat(F.lit("u"), F.nullif(F.col("user_id") % 5, F.lit(0)).cast("string")).alias("id"), F.col("key").alias("time"), "value", "event_id", "event_type")
    flat = records.flatten_record(rows, ids=[("id", "none")], fields=["event_type"], prefix="p")
    return flat.select("column_path", "key", F.col("value").cast("double").alias("number"), "value_type")


@query("SELECT 'u' || user_id || '/event_type' AS column_path, epoch_us(ts) // 1000 AS key, event_type AS value, 'string' AS value_type FROM events")
def flatten_named_fields(spark, sf_dir):
    e = series(spark, sf_dir, "event_id", "user_id", "event_type")
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("key").alias("time"), "value", "event_id", "event_type")
    records.check_record_schema(rows.schema)
    return records.flatten_record(rows, fields=["event_type"], mode="whitelist")


@query("SELECT column_path, key, value FROM {S}")
def loaded_events(spark, sf_dir):
    """One reader for two inputs."""
    folder, e = fresh_path(spark, "inputs"), series(spark, sf_dir, "event_id")
    inputs = [f"{folder}/{half}" for half in (0, 1)]
    for half, path in enumerate(inputs):
        e.where(F.col("event_id") % 2 == half).drop("event_id").write.parquet(path)
    return records.load_events(spark, inputs, lambda s, path: s.read.parquet(path))


# Topics


def _messages(spark: SparkSession, sf_dir: str) -> str:
    """The events as messages of a topic: a folder stands in for the server."""
    servers, e = fresh_path(spark, "topics"), series(spark, sf_dir, "event_id")
    bad = lambda df: F.when(F.col("n") % 10 == 0, F.lit("{")).otherwise(F.to_json(F.struct("column_path", "key", "value")))
    sinks.write_topic(e.withColumnRenamed("event_id", "n").repartition(4), "items", servers, bad, fmt="parquet")
    return servers


@query("""SELECT 'item' AS what, column_path, key, value * 2 AS value FROM {S} WHERE event_id % 10 <> 0
UNION ALL SELECT 'deserialize', NULL, -1, CAST(count(*) AS DOUBLE) FROM events WHERE event_id % 10 = 0""")
def topic_round_trip(spark, sf_dir):
    """Items sent to a topic, read back at a limited rate, decoded, transformed and written to a store, failures counted."""
    servers, kept, errors = _messages(spark, sf_dir), store.SeriesStore(spark, fresh_path(spark, "store")), fresh_path(spark, "errors")
    decoder = registry.decoder_for("items", {"items": records.decode_json_message})
    raw = streams.follow(spark, f"{servers}/items", "key binary, value binary", max_files=1)
    double = lambda df: df.withColumn("value", F.col("value") * 2)
    streams.load_stream(raw, decoder, kept, "double", fresh_path(spark, "progress"), errors, [lambda df: load.chain(df, [double])]).awaitTermination()
    items = kept.scan("double").select(F.lit("item").alias("what"), "column_path", "key", "value")
    failed = spark.read.parquet(errors).groupBy(F.col("error").alias("what")).agg(F.sum("count").cast("double").alias("value"))
    return items.unionByName(failed.select("what", F.lit(None).cast("string").alias("column_path"), F.lit(-1).cast("long").alias("key"), "value"))


@query("SELECT column_path, key, value FROM {S} WHERE event_id % 10 <> 0")
def topic_items(spark, sf_dir):
    stream = records.stream_topic(spark, "items", records.decode_json_message, _messages(spark, sf_dir), max_offsets=2, fmt="parquet")
    return sent(spark, stream.where("error IS NULL").drop("error"), "append").drop("ingest_seq")


# Stores


@query("SELECT column_path, key, CASE WHEN event_id % 5 = 0 THEN value + 3 WHEN event_id % 3 = 0 THEN value + 2 WHEN event_id % 2 = 0 THEN value + 1 ELSE value END AS value, 'double' AS value_type FROM {S}")
def store_last_write_wins(spark, sf_dir):
    """Batch, stream, batch and repeated writes to a store, then one that puts it together."""
    kept, e = store.SeriesStore(spark, fresh_path(spark, "store")), series(spark, sf_dir, "event_id")
    more = lambda n, by: e.where(F.col("event_id") % n == 0).withColumn("value", F.col("value") + by).drop("event_id")
    kept.write(e, "double")
    kept.write(more(2, 1), "double", "second")
    folder = fresh_path(spark, "arriving")
    more(3, 2).write.parquet(folder)
    streams.write_stream(streams.follow(spark, folder, "column_path string, key long, value double"), kept, "double", fresh_path(spark, "progress")).awaitTermination()
    kept.write(more(1, 9), "double", "second")  # a write of that name is there
    kept.write(more(5, 3), "double")
    kept.compact("double")
    return kept.scan("double")


@query("SELECT column_path, key, value, 'double' AS value_type FROM {S} WHERE user_id <> 7 UNION ALL SELECT column_path, key, -value, 'double' FROM {S} WHERE user_id = 7 AND event_id % 2 = 0")
def store_after_erasing(spark, sf_dir):
    """A store emptied, filled, one column erased and partly written again."""
    kept, e = store.SeriesStore(spark, fresh_path(spark, "store")), series(spark, sf_dir, "event_id", "user_id")
    kept.write(e.withColumn("value", F.lit(0.0)), "double")
    kept.reset()
    kept.write(e, "double")
    kept.erase_column("events/u7/value", "double")
    kept.write(e.where("user_id = 7 AND event_id % 2 = 0").withColumn("value", -F.col("value")), "double")
    return kept.scan("double")


@query("""SELECT CAST(key AS VARCHAR) AS key, click, view FROM (PIVOT (SELECT event_type, epoch_us(ts) // 1000 // 3600000 * 3600000 AS key, CAST(count(*) AS VARCHAR) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2) ON event_type IN ('click', 'view') USING max(n) GROUP BY key)""")
def exported_wide(spark, sf_dir):
    """A wide tab-separated export, read again."""
    out, hour = fresh_path(spark, "export"), F.floor(F.col("key") / 3_600_000) * 3_600_000
    counts = series(spark, sf_dir, "event_type").groupBy(F.concat(F.lit("n/"), "event_type").alias("column_path"), hour.alias("key")).agg(F.count("*").alias("value"))
    tabular.export_wide(counts, ["n/view", "n/click"], out)
    return spark.read.option("sep", "\t").option("header", True).csv(out)


@query("WITH e AS (SELECT epoch_us(ts) // 1000 // 3600000 AS key, event_type, value, event_id FROM events) SELECT key, arg_min(value, event_id) FILTER (WHERE event_type = 'click') AS click, arg_min(value, event_id) FILTER (WHERE event_type = 'view') AS view, min(event_id) AS first_seen FROM e WHERE event_type IN ('click', 'view') GROUP BY 1")
def tabular_first_value(spark, sf_dir):
    """Many values at one key: the first counts, and keys know when they were first seen."""
    e = series(spark, sf_dir, "event_type", "event_id").withColumn("key", F.floor(F.col("key") / 3_600_000))
    return tabular.tabular(e, ["click", "view"], by="event_type", order="event_id")


@query("SELECT column_path, value, true AS arrived FROM {S}")
def stamped_items(spark, sf_dir):
    return sinks.stamp_arrival(series(spark, sf_dir).drop("key")).select("column_path", "value", (F.col("key") > T3).alias("arrived"))


# Catalog


@query(f"SELECT DISTINCT column_path FROM {PATHS}")
def all_columns(spark, sf_dir):
    return catalog.all_columns(catalog_paths(spark, sf_dir))


@query("SELECT column_path, key, value FROM {S} WHERE user_id = 1")
def column_items(spark, sf_dir):
    return catalog.column(series(spark, sf_dir), "events/u1/value")


@query(f"SELECT DISTINCT 'app/u' || user_id AS entity_path FROM {PATHS}")
def entities_found(spark, sf_dir):
    return catalog.find_entities(catalog_paths(spark, sf_dir), "app", required=True)


@query(f"SELECT DISTINCT column_path FROM {PATHS}")
def dataset_columns(spark, sf_dir):
    return catalog.dataset_columns(catalog_paths(spark, sf_dir), "app")


@query(f"SELECT count(*) AS items FROM {{S}} WHERE key >= {T1} AND key < {T2} UNION ALL SELECT count(*) FROM {{S}} WHERE key < {T2} UNION ALL SELECT count(*) FROM {{S}}")
def items_counted(spark, sf_dir):
    e = series(spark, sf_dir)
    return catalog.items_in_range(e, T1, T2).unionByName(catalog.items_in_range(e, until=T2)).unionByName(catalog.items_in_range(e))


# Reductions and intervals


@query("SELECT column_path, 0 AS range_id, key // 60000 * 60000 AS key, round(sum(value), 4) AS value FROM {S} GROUP BY 1, 3")
def reduce_sum_by_minute(spark, sf_dir):
    """Far more periods than any cap a server would set."""
    return four(reduce(series(spark, sf_dir), "sum", Grouping(period="1 minute")))


@query("SELECT user_id, bit_xor(event_id) AS value FROM events GROUP BY 1")
def folded_values(spark, sf_dir):
    e = series(spark, sf_dir, "user_id", "event_id").select("user_id", "key", F.col("event_id").alias("value"))
    return fold_values(e, ["user_id"], lambda a, b: a.bitwiseXOR(b), F.lit(0).cast("long"), rows=8)


TWO = [SeriesRange(T1, T2), SeriesRange(T2, T3)]
_RANGED = f"""r AS (SELECT 0 AS range_id, CAST({T1} AS BIGINT) AS a, CAST({T2} AS BIGINT) AS b UNION ALL SELECT 1, {T2}, {T3}),
o AS (SELECT range_id, column_path, key AS start, key + CAST(trunc(value * 100000) AS BIGINT) AS "end", b FROM {{S}} JOIN r ON key >= a AND key < b)"""


@query(f"""WITH {_RANGED}, {MERGE.format(g='range_id, column_path')}, {CUT.format(g='range_id, column_path')},
w AS (SELECT v.range_id, column_path, v.key, v.part FROM v)
SELECT range_id, column_path, key, CAST(sum(part) AS BIGINT) AS value FROM w WHERE part > 0 AND key < (SELECT b FROM r WHERE r.range_id = w.range_id) GROUP BY 1, 2, 3""")
def interval_sum_of_ranges(spark, sf_dir):
    """Every range of a request (F15); both end at midnight, so days are cut at the range's end."""
    return registry.run("IntervalSum", durations(spark, sf_dir), {"period": "1 day", "ranges": TWO})


@query(f"""WITH {DURATIONS}, {MERGE.format(g='column_path')}, {CUT.format(g='column_path')},
s AS (SELECT column_path, key, CAST(sum(part) AS BIGINT) AS value FROM v WHERE part > 0 AND column_path IN ('events/u1/value', 'events/u2/value', 'events/u3/value') GROUP BY 1, 2)
SELECT key, coalesce(max(value) FILTER (WHERE column_path = 'events/u1/value'), 0) AS u1, coalesce(max(value) FILTER (WHERE column_path = 'events/u2/value'), 0) AS u2, coalesce(max(value) FILTER (WHERE column_path = 'events/u3/value'), 0) AS u3 FROM s GROUP BY 1""")
def interval_sum_across_columns(spark, sf_dir):
    """Sums of several series side by side, zero where one has none (F15 with E1 and E2)."""
    names = ["u1", "u2", "u3"]
    return registry.run("IntervalSum", durations(spark, sf_dir), {"period": "1 day", "columns": [f"events/{n}/value" for n in names], "names": names})


_LOW = SIGNALS.replace("value > 250", "value > 30")


@query(f"WITH {_LOW}, {ISLANDS.format(by='column_path')} SELECT column_path, start, \"end\" FROM o")
def onoff_intervals_dense(spark, sf_dir):
    return intervals.onoff_to_intervals(series(spark, sf_dir).withColumn("value", F.col("value") > 30))


_CLIPPED = f"""{_LOW}, r AS (SELECT 0 AS range_id, CAST({T1} AS BIGINT) AS a, CAST({T2} AS BIGINT) AS z UNION ALL SELECT 1, {T2}, {T3}),
i AS (SELECT range_id, user_id, column_path, key, on_, a, z, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY range_id, column_path ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM b JOIN r ON key >= a - 86400000 AND key < z),
oo AS (SELECT range_id, user_id, a, z, min(key) FILTER (WHERE on_) AS start, max(key) AS "end" FROM i GROUP BY range_id, user_id, column_path, a, z, coalesce(g, 0) HAVING bool_or(on_)),
o AS (SELECT range_id, user_id % 3 AS group_id, greatest(start, a) AS start, "end" FROM oo WHERE "end" >= a)"""


@query(f"WITH {_CLIPPED}, {MERGE.format(g='range_id, group_id')} SELECT range_id, group_id, min(start) AS key, CAST(sum(\"end\" - start) AS BIGINT) AS value FROM u GROUP BY 1, 2")
def onoff_interval_sum_of_ranges(spark, sf_dir):
    """Every range of a request, clipped to it (F16)."""
    e = series(spark, sf_dir, "user_id")
    selection = e.select((F.col("user_id") % 3).alias("group_id"), "column_path").distinct()
    return registry.run("OnOffIntervalSum", e.select("column_path", "key", (F.col("value") > 30).alias("value")), {"ranges": TWO}, selection)


@query("SELECT column_path, key, value FROM {S} WHERE value > 30 AND user_id % 2 = 0")
def watched_even_users(spark, sf_dir):
    e = series(spark, sf_dir, "user_id")
    return ranges.watch(e, (F.col("value") > 30) & (F.col("user_id") % 2 == 0)).drop("user_id")


# Scalars


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') AS minute, epoch_us(date_trunc('minute', ts)) // 1000 AS back, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS at FROM events")
def iso_texts(spark, sf_dir):
    e = series(spark, sf_dir, "event_id")
    minute = scalars.ms_to_minute_text(F.col("key"))
    return e.select("event_id", minute.alias("minute"), scalars.iso_to_ms(minute).alias("back"), F.date_format(scalars.ms_to_date(F.col("key")), "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


_TEXT = "CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN event_id || '.5' WHEN 2 THEN 'True' WHEN 3 THEN '{\"a\": ' || event_id || '}' WHEN 4 THEN 'x' || event_id ELSE 'FALSE' END"


@query(f"""WITH t AS (SELECT event_id, {_TEXT} AS t FROM events)
SELECT event_id, CASE WHEN t = 'True' THEN true WHEN t = 'FALSE' THEN false END AS as_boolean, left(t, 1) AS as_char, coalesce(TRY_CAST(CASE WHEN event_id % 6 = 0 THEN t END AS SMALLINT), -1)::SMALLINT AS as_short,
coalesce(TRY_CAST(CASE WHEN event_id % 6 = 0 THEN t END AS BIGINT), -1) AS as_long, CASE WHEN event_id % 6 < 2 THEN CAST(t AS DOUBLE) END AS as_double, t AS as_string, CASE WHEN event_id % 6 = 3 THEN t END AS as_json FROM t""")
def parsed_values(spark, sf_dir):
    n = F.col("event_id").cast("string")
    texts = [n, F.concat(n, F.lit(".5")), F.lit("True"), F.concat(F.lit('{"a": '), n, F.lit("}")), F.concat(F.lit("x"), n), F.lit("FALSE")]
    text = F.coalesce(*[F.when(F.col("event_id") % 6 == i, t) for i, t in enumerate(texts)])
    e = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    json = F.when(F.col("t").startswith("{"), scalars.parse_value(F.col("t"), "json"))
    parsed = e.select("event_id", *[scalars.parse_value(F.col("t"), k).alias(f"as_{k}") for k in ("boolean", "char", "short", "long", "double", "string")], json.alias("as_json"))
    return parsed.na.fill(-1, ["as_short", "as_long"])


@query("SELECT p_partkey, split_part(p_name, ' ', -1) || '.x' AS last, split_part(p_name, ' ', 1) AS first, 'x' AS suffix, format('{:,}', p_partkey * 1000003) AS grouped, CAST(p_partkey AS VARCHAR) AS shown, CAST(p_partkey % 2 = 0 AS VARCHAR) AS flag FROM part")
def text_pieces(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".x"))
    first = scalars.first_part(F.replace("p_name", F.lit(" "), F.lit("/")))
    return p.select("p_partkey", scalars.last_part(path).alias("last"), first.alias("first"), scalars.suffix(path).alias("suffix"), scalars.grouped_integer(F.col("p_partkey") * 1000003).alias("grouped"),
                    scalars.to_text(F.col("p_partkey")).alias("shown"), scalars.to_text(F.col("p_partkey") % 2 == 0).alias("flag"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 30000 WHEN 2 THEN 259200000 WHEN 3 THEN 1209600000 ELSE 31536000000 END AS length FROM events")
def period_lengths(spark, sf_dir):
    texts = ("1500 microseconds", "30 seconds", "3 days", "2 weeks", "1 year")
    length = F.coalesce(*[F.when(F.col("event_id") % 5 == i, F.lit(Period.parse(t).millis()).cast("long")) for i, t in enumerate(texts)])
    return table(spark, sf_dir, "events").select("event_id", length.alias("length"))


# Streams


@query("SELECT column_path, key // 86400000 * 86400000 AS key, max(value) AS value FROM {S} GROUP BY 1, 2")
def stream_by_processing_time(spark, sf_dir):
    """Batches at a processing-time interval, until all that is there has been read (K2)."""
    out = fresh_path(spark, "sent")
    save = lambda b, n: b.withColumn("ingest_seq", F.lit(n)).write.mode("append").parquet(out)
    running = streams.start(streams.stream_reduce(arriving(spark, sf_dir), "max", "1 day"), save, fresh_path(spark, "progress"), {"processingTime": "200 milliseconds"}, "update")
    running.processAllAvailable()
    running.stop()
    return store.latest_wins(spark.read.parquet(out)).drop("ingest_seq")


@query(f"SELECT column_path, key // 3600000 * 3600000 AS key, count(value) AS value FROM {{S}} WHERE key < {T3} AND NOT (event_id % 4 = 0 AND key < {T2}) GROUP BY 1, 2")
def stream_without_late_items(spark, sf_dir):
    """A quarter of the early items comes after all others: past the watermark, they are dropped; the stream ends at a key (K7, K8)."""
    e, folder = series(spark, sf_dir, "event_id"), fresh_path(spark, "late")
    files = quarter_files(e)
    late = (F.col("event_id") % 4 == 0) & (F.col("key") < T2)
    for part in (~late & (F.col("key") < T3 - 3_600_000), ~late & (F.col("key") >= T3 - 3_600_000), late):
        e.where(part).drop("event_id").repartition(files).write.mode("append").parquet(folder)
    stream = streams.follow(spark, folder, "column_path string, key long, value double", max_files=files)
    return store.latest_wins(sent(spark, streams.stream_reduce(stream, "count", "1 hour", until=T3, late="1 hour"), "update")).drop("ingest_seq")


@query("""WITH b AS (SELECT *, (SELECT min(key) FROM {S}) AS low, (SELECT max(key) + 1 FROM {S}) AS high FROM {S})
SELECT CASE WHEN key < low + (high - low) // 4 THEN 0 WHEN key < low + (high - low) * 2 // 4 THEN 1 WHEN key < low + (high - low) * 3 // 4 THEN 2 ELSE 3 END AS block, column_path, key, '[' || key || ',' || event_id || ']' AS pair FROM b""")
def stream_json_blocks(spark, sf_dir):
    """An initial block and its updates."""
    out = fresh_path(spark, "blocks")
    items = arriving(spark, sf_dir, "event_id").select("column_path", "key", F.col("event_id").alias("value"))
    streams.json_blocks(items, out, fresh_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out)


@query("""WITH h AS (SELECT column_path, key // 86400000 AS d, max(value) AS value FROM {S} GROUP BY 1, 2),
e AS (SELECT column_path, unnest(generate_series(min(d), max(d))) AS d FROM h GROUP BY 1)
SELECT e.column_path, e.d * 86400000 AS key, h.value FROM e LEFT JOIN h ON e.column_path = h.column_path AND e.d = h.d""")
def stream_max_with_empties(spark, sf_dir):
    return streams.newest_with_empties(sent(spark, streams.stream_reduce_with_empties(arriving(spark, sf_dir), "1 day", fn="max"), "update")).drop("ingest_seq")


@query("""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY column_path ORDER BY key) - 1) // 10 AS p, count(*) OVER (PARTITION BY column_path) AS c FROM {S})
SELECT column_path, min(key) AS key, min(value) AS value FROM n WHERE (p + 1) * 10 <= c GROUP BY column_path, p""")
def stream_min_of_tens(spark, sf_dir):
    return sent(spark, streams.stream_count_reduce(arriving(spark, sf_dir), 10, "min"), "append").drop("ingest_seq")


# Plug points


@query("SELECT column_path, 0 AS range_id, key // 86400000 * 86400000 AS key, round(max(value) - min(value), 4) AS value FROM {S} GROUP BY 1, 3")
def plugged_reducer(spark, sf_dir):
    registry.register_reducer("spread", lambda c: F.max(c) - F.min(c))
    return four(registry.run("reduceSpread", series(spark, sf_dir), {"period": "1 day"}))


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS group_id, count(*) AS items, round(sum(value) * 3, 2) AS value FROM {S} GROUP BY 1")
def plugged_transform_of_groups(spark, sf_dir):
    """A selector of one's own gives the groups, a transform of one's own reduces each."""
    e = series(spark, sf_dir, "user_id")
    registry.register_selector("ByParity", lambda s, p: e.select((F.col("user_id") % p["n"]).cast("int").alias("group_id"), "column_path").distinct())
    registry.register_transform("GroupTotals", lambda df, p: df.groupBy("group_id").agg(F.count("*").alias("items"), F.round(F.sum("value") * p["times"], 2).alias("value")))
    return registry.run("GroupTotals", e.drop("user_id"), {"times": 3}, registry.selection_by(spark, "ByParity", {"n": 2}))


class DottedPaths(scalars.PathFormat):
    """Paths whose last dot parts dataset and column."""

    def split(self, path):
        return F.regexp_replace(path, r"\.[^.]*$", ""), scalars.suffix(path)


@query(f"SELECT replace(column_path, '/', '.') AS column_path, 'app.u' || user_id AS dataset, event_type AS \"column\" FROM {PATHS}")
def plugged_path_format(spark, sf_dir):
    dotted = catalog_paths(spark, sf_dir).select(F.replace("column_path", F.lit("/"), F.lit(".")).alias("column_path"))
    return catalog.split_paths(dotted, DottedPaths())


@query("SELECT event_id, event_id % 1000 AS cents, (event_id % 1000) // 100 || '.' || right('0' || (event_id % 100), 2) AS shown FROM events")
def plugged_value_type(spark, sf_dir):
    """A value type of one's own: money as whole cents."""
    show = lambda c: F.format_string("%d.%02d", F.floor(c / 100).cast("long"), F.pmod(c, F.lit(100)).cast("long"))
    registry.register_type("money", "bigint", lambda t: F.round(t.try_cast("decimal(20,2)") * 100).cast("bigint"), show)
    kind, parse, shown = registry.logical_type("money")
    text = F.format_string("%d.%02d", F.floor(F.col("event_id") % 1000 / 100).cast("long"), (F.col("event_id") % 100).cast("long"))
    e = table(spark, sf_dir, "events").select("event_id", parse(text).cast(kind).alias("cents"))
    return e.select("event_id", "cents", shown(F.col("cents")).alias("shown"))
