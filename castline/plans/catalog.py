"""The registered queries: each operator applied to the driver's tables, with equal SQL where SQL can say it.

``QUERIES`` maps a name to (spark, sf_dir) -> DataFrame; ``SQL`` holds the DuckDB text of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from castline.functions import text as t
from castline.functions.exact import nfc, round_exact, short_number, similarity, title_case
from castline.operators import aggregates, impact, intake, joins, matching, merge, mixing, nearest, production, scripts, sequence, timeline
from castline.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as entries of episodes: a system turn is a direction, the others are dialogue."""
    rows = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "direction").otherwise("dialogue")
    return rows.select("conv_id", (F.col("turn") + 1).cast("long").alias("seq"), kind.alias("type"), F.when(F.col("turn") == 0, "opening").otherwise("").alias("section"), F.col("role").alias("speaker"), "text")


def happenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds."""
    return read(spark, sf_dir, "events").withColumn("moment", F.unix_micros(F.col("ts").cast("timestamp")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines numbered within their order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(order).cast("long"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "raw")).select("doc", (F.col("at") + 1).cast("long").alias("line_no"), "raw")


TURNS = """turns AS (SELECT conv_id, CAST(turn + 1 AS BIGINT) AS seq, CASE WHEN role = 'system' THEN 'direction' ELSE 'dialogue' END AS type,
    CASE WHEN turn = 0 THEN 'opening' ELSE '' END AS section, role AS speaker, text FROM conversations)"""
HAPPENINGS = "happenings AS (SELECT *, epoch_us(ts) AS moment FROM events)"
ITEMS = "items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem)"
WORDS = r"CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT)"


# Aggregates


@query(f"""WITH {TURNS}, sums AS (SELECT speaker, count(*) AS lines, CAST(sum({WORDS}) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars, min(seq) AS seen FROM turns GROUP BY 1)
    SELECT speaker, lines, words, chars,
        CAST(printf('%.1f', lines / greatest(sum(lines) OVER (), 1) * 100) AS DOUBLE) AS pct_lines, CAST(printf('%.1f', words / greatest(sum(words) OVER (), 1) * 100) AS DOUBLE) AS pct_words,
        CAST(printf('%.1f', chars / greatest(sum(chars) OVER (), 1) * 100) AS DOUBLE) AS pct_chars, CAST(row_number() OVER (ORDER BY lines DESC, seen, speaker) AS INTEGER) AS place FROM sums""")
def speaker_stats(spark, sf_dir):
    return aggregates.speaker_stats(turns(spark, sf_dir))


_STATS = """SELECT conv_id, count(*) AS total_entries, count(*) FILTER (type = 'dialogue') AS dialogue_lines, count(*) FILTER (type = 'direction') AS direction_lines,
    CAST(coalesce(sum(length(text)) FILTER (type = 'dialogue'), 0) AS BIGINT) AS characters_for_tts,
    coalesce(string_agg(DISTINCT speaker, ',' ORDER BY speaker) FILTER (type = 'dialogue'), '') AS speakers, coalesce(string_agg(DISTINCT section, ',') FILTER (section <> ''), '') AS sections"""


def _joined(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"speakers": F.array_join("speakers", ","), "sections": F.array_join("sections", ",")})


@query(f"WITH {TURNS} {_STATS} FROM turns GROUP BY conv_id")
def doc_stats(spark, sf_dir):
    return _joined(aggregates.document_stats(turns(spark, sf_dir), ["conv_id"]))


@query(f"WITH {TURNS}, body AS (SELECT * REPLACE (seq - 1 AS seq) FROM turns) {_STATS} FROM body WHERE seq > 0 GROUP BY conv_id")
def body_stats(spark, sf_dir):
    return _joined(aggregates.document_stats(turns(spark, sf_dir).withColumn("seq", F.col("seq") - 1), ["conv_id"], body_only=True))


@query(f"""WITH sums AS (SELECT source AS "show", lang AS tag, count(*) AS dialogue_lines, CAST(sum({WORDS}) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS tts_chars FROM documents GROUP BY 1, 2)
    SELECT *, CAST(row_number() OVER (ORDER BY "show", coalesce(TRY_CAST(regexp_extract("show", '\\d+$') AS INTEGER), 999), 999, tag) AS INTEGER) AS place FROM sums""")
def episode_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("show"), F.col("lang").alias("tag"), F.lit("dialogue").alias("type"), "text")
    found = aggregates.episode_summary(rows, ["show", "tag"]).withColumns({"season": F.regexp_extract("show", r"\d+$", 0), "episode": F.lit("")})
    return found.withColumn("place", F.row_number().over(Window.orderBy(*aggregates.episode_order()))).drop("season", "episode")


_TIER = "CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'middle' ELSE 'high' END"


@query(f"""SELECT CASE WHEN grouping(event_type) = 1 THEN 'TOTAL' ELSE event_type END AS event_type, count(*) FILTER ({_TIER} = 'low') AS low, count(*) FILTER ({_TIER} = 'middle') AS middle,
    count(*) FILTER ({_TIER} = 'high') AS high, count(*) AS "all" FROM events GROUP BY ROLLUP (event_type)""")
def tier_pivot_total(spark, sf_dir):
    return aggregates.cross_table(read(spark, sf_dir, "events"), "event_type", F.expr(_TIER), ["low", "middle", "high"])


@query(f"""SELECT tier, CAST(place AS INTEGER) AS place, coalesce(n, 0) AS "rows" FROM (VALUES ('low', 0), ('middle', 1), ('high', 2), ('none', 3)) d(tier, place)
    LEFT JOIN (SELECT {_TIER} AS tier, count(*) AS n FROM events GROUP BY 1) USING (tier)""")
def tier_tally(spark, sf_dir):
    return aggregates.tally(read(spark, sf_dir, "events"), F.expr(_TIER), ["low", "middle", "high", "none"])


@query("""SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'TOTAL' ELSE o_orderpriority END AS o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS chosen_rows,
    CAST(coalesce(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) FILTER (o_orderstatus = 'O'), 0) AS BIGINT) AS chosen_amount, count(*) FILTER (o_orderstatus <> 'O') AS skipped_rows,
    CAST(coalesce(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) FILTER (o_orderstatus <> 'O'), 0) AS BIGINT) AS skipped_amount FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def gen_skip_rollup(spark, sf_dir):
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    return aggregates.split_totals(read(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "O", cents)


@query("""SELECT l_returnflag, count(*) AS cues, CAST(sum(l_quantity) * 40 AS BIGINT) AS credits_cut, CAST(sum(ceil(CASE WHEN l_quantity > 0 THEN least(l_quantity, 30.0) ELSE 5.0 END * 40)) AS BIGINT) AS credits_up
    FROM lineitem GROUP BY 1""")
def credit_budget(spark, sf_dir):
    return aggregates.credit_budget(read(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_quantity"))


_STATUS = f"""WITH {HAPPENINGS}, i AS (SELECT user_id, max(moment) AS newest_input FROM happenings WHERE event_type = 'view' GROUP BY 1),
    o AS (SELECT user_id, max(moment) AS newest_output, min(moment) AS oldest_output, count(*) AS output_count FROM happenings WHERE event_type = 'purchase' AND value > 20 GROUP BY 1),
    s AS (SELECT user_id, newest_input, newest_output, oldest_output, coalesce(output_count, 0) AS output_count,
        CASE WHEN newest_output IS NULL THEN 'MISSING' WHEN newest_input > newest_output THEN 'STALE' ELSE 'OK' END AS status FROM i FULL JOIN o USING (user_id))"""


@query(f"{_STATUS} SELECT * FROM s")
def stage_status(spark, sf_dir):
    rows = happenings(spark, sf_dir)
    return aggregates.stage_status(rows.where("event_type = 'view'"), rows.where("event_type = 'purchase' AND value > 20"), "user_id", "moment")


@query(f"{_STATUS} SELECT user_id % 10 AS team, CASE max(CASE status WHEN 'MISSING' THEN 2 WHEN 'STALE' THEN 1 ELSE 0 END) WHEN 2 THEN 'MISSING' WHEN 1 THEN 'STALE' ELSE 'OK' END AS worst FROM s GROUP BY 1")
def worst_status(spark, sf_dir):
    return aggregates.worst(stage_status(spark, sf_dir).withColumn("team", F.col("user_id") % 10), "team")


@query(f"WITH {HAPPENINGS} SELECT user_id, event_type, max(moment) AS latest FROM happenings GROUP BY 1, 2")
def keep_latest(spark, sf_dir):
    return aggregates.keep_latest(happenings(spark, sf_dir), ["user_id", "event_type"], "moment")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_retailprice, p_partkey) AS k FROM part),
    o AS (SELECT p_type, p_size, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) FILTER (k > 1) AS also_in FROM r GROUP BY 1, 2)
    SELECT p_type, p_size, p_partkey, p_name, coalesce(also_in, '') AS also_in FROM r JOIN o USING (p_type, p_size) WHERE k = 1""")
def pool_dedupe(spark, sf_dir):
    found = aggregates.deduped_pool(read(spark, sf_dir, "part"), ["p_type", "p_size"], [F.col("p_retailprice"), F.col("p_partkey")], "p_brand")
    return found.select("p_type", "p_size", "p_partkey", "p_name", F.array_join("also_in", ",").alias("also_in"))


@query("""WITH c AS (SELECT l_returnflag, CAST(floor(l_linenumber * 250 / 500) AS BIGINT) AS chunk, floor(sqrt(avg(l_quantity * l_quantity))) AS rms FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, CAST(min(rms) AS BIGINT) AS quietest FROM c GROUP BY 1""")
def loudness_profile(spark, sf_dir):
    found = aggregates.loudness(read(spark, sf_dir, "lineitem").withColumn("ms", F.col("l_linenumber") * 250), ["l_returnflag"], "ms", "l_quantity")
    return found.select("l_returnflag", F.round(F.pow(F.lit(10.0), F.col("quietest_db") / 20) * 32768).cast("long").alias("quietest"))


# Joins


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p.p_partkey IS NOT NULL THEN coalesce(p.p_type, 'sfx') END AS sfx_type, CASE WHEN p.p_partkey IS NOT NULL THEN regexp_replace(p.p_name, ' ', '-', 'g') END AS sfx_slug,
    p.p_partkey IS NOT NULL AS sfx_matched, s.s_name AS cast_name, s.s_suppkey IS NOT NULL AS cast_matched FROM lineitem
    LEFT JOIN part p ON l_returnflag = 'R' AND l_partkey = p_partkey LEFT JOIN supplier s ON l_linestatus = 'F' AND l_suppkey = s_suppkey AND s_acctbal > 0""")
def annotate_join(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    sounds = {"sfx_type": F.coalesce("p_type", F.lit("sfx")), "sfx_slug": t.effect_slug(F.col("p_name"))}
    rows = joins.annotate(rows, read(spark, sf_dir, "part"), F.col("l_returnflag") == "R", "l_partkey", "p_partkey", sounds, "sfx_matched")
    voices = read(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return joins.annotate(rows, voices, F.col("l_linestatus") == "F", "l_suppkey", "s_suppkey", {"cast_name": F.col("s_name")}, "cast_matched").drop("l_returnflag", "l_linestatus")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_stem' WHEN quality = 0 THEN 'not_transcribed' WHEN toxic = 1 THEN 'silent' WHEN d.doc_id % 5 = 0 THEN 'garbled' ELSE 'ok' END AS status,
    CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 OR d.doc_id % 5 = 0 THEN 0.0 ELSE 1.0 END END::DOUBLE AS similarity FROM documents d LEFT JOIN labels l USING (doc_id)""")
def compare_status(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", "text")
    said = F.when(F.col("toxic") == 1, " ").when(F.col("doc_id") % 5 == 0, "※ ※").otherwise(F.col("text"))
    heard = read(spark, sf_dir, "labels").join(lines, "doc_id").select("doc_id", (F.col("quality") == 1).alias("has_transcript"), said.alias("transcript"))
    return joins.compare_transcripts(lines, heard, on=["doc_id"]).select("doc_id", "status", "similarity")


@query("""SELECT d.doc_id, d.lang, d.n_chars AS logged, CAST(CASE WHEN quality = 1 THEN length(text) - quality END AS BIGINT) AS actual, CAST(abs(CASE WHEN quality = 1 THEN length(text) - quality END - d.n_chars) AS BIGINT) AS delta,
    CASE WHEN quality IS NULL OR quality = 0 THEN 'unmatched' WHEN abs(length(text) - quality - d.n_chars) > 0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels USING (doc_id)""")
def audit_delta(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    actual = rows.join(read(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id", "lang", (F.length("text") - F.col("quality")).cast("long").alias("actual"))
    return joins.audit(rows.select("doc_id", "lang", F.col("n_chars").cast("long").alias("logged")), actual, ["doc_id", "lang"], "logged", "actual")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000)")
def new_keys_anti(spark, sf_dir):
    """Customers without a large order in progress."""
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rejected_semi(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "source")


_STALE = """WITH stems AS (SELECT DISTINCT printf('%03d', l_orderkey) || '_main_' || CASE l_returnflag WHEN 'R' THEN 'sfx' ELSE lower(l_returnflag) END AS base, l_orderkey AS seq FROM lineitem),
    entries AS (SELECT o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'dialogue' WHEN 'P' THEN 'direction' ELSE 'scene_header' END AS type, CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'n' END AS speaker FROM orders WHERE o_orderkey % 7 <> 0),
    j AS (SELECT stems.*, type, speaker, count(*) OVER (PARTITION BY stems.seq) AS same, printf('%03d', stems.seq) || '_main_' || CASE WHEN type = 'dialogue' THEN speaker ELSE 'sfx' END AS expected, suffix(base, '_sfx') AS sound FROM stems LEFT JOIN entries USING (seq)),
    r AS (SELECT base || '.mp3' AS path, seq, CASE WHEN type IS NULL THEN 'seq not in parsed JSON' WHEN type = 'scene_header' THEN 'seq ' || seq || ' is now a scene_header entry'
        WHEN same > 1 AND base <> expected THEN 'seq ' || seq || ' duplicate (expected ' || expected || ')' WHEN same > 1 THEN NULL WHEN sound AND type = 'dialogue' THEN 'seq ' || seq || ' is now a dialogue entry'
        WHEN NOT sound AND type = 'direction' THEN 'seq ' || seq || ' is now a direction entry' WHEN type = 'dialogue' AND NOT suffix(base, '_' || speaker) THEN 'seq ' || seq || ' speaker is now ' || speaker END AS reason FROM j)
    SELECT * FROM r WHERE reason IS NOT NULL"""


@query(_STALE)
def stale_audit(spark, sf_dir):
    who = F.when(F.col("l_returnflag") == "R", "sfx").otherwise(F.lower("l_returnflag"))
    # Two short columns are made distinct; names are put together for what is left.
    kinds = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag").distinct()
    stems = kinds.select(F.concat(F.format_string("%03d", "l_orderkey"), F.lit("_main_"), who).alias("base"), F.col("l_orderkey").alias("seq")).withColumn("path", F.concat("base", F.lit(".mp3")))
    kind = F.when(F.col("o_orderstatus") == "O", "dialogue").when(F.col("o_orderstatus") == "P", "direction").otherwise("scene_header")
    speaker = F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("n")
    entries = read(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("seq"), kind.alias("type"), F.lit("main").alias("section"), F.lit(None).cast("string").alias("scene"), speaker.alias("speaker"))
    return joins.stale_stems(stems, entries)


@query("""WITH m AS (SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS made FROM orders GROUP BY 1)
    SELECT c_custkey AS o_custkey, made, CASE WHEN made IS NULL THEN 'missing' WHEN made % 5 = 0 THEN 'missing' WHEN made % 3 = 0 THEN 'missing' WHEN made % 2 = 0 THEN 'correct' ELSE 'relink' END AS state,
    CASE WHEN made IS NULL THEN 'not in manifest' WHEN made % 5 = 0 THEN 'file gone' WHEN made % 3 = 0 THEN 'content changed' END AS reason FROM customer LEFT JOIN m ON c_custkey = o_custkey""")
def reconcile(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    path = lambda k: F.concat(F.lit("s"), k.cast("string"))
    key = F.col("o_orderkey")
    manifest = orders.select("o_custkey", key.alias("at"), path(key).alias("path"), key.cast("string").alias("sha256"))
    present = orders.where("o_orderkey % 5 <> 0").select(path(key).alias("path"), F.when(key % 3 == 0, "other").otherwise(key.cast("string")).alias("sha256"))
    last = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("made"))
    lines = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).join(last, "o_custkey", "left").withColumn("expected_path", F.when(F.col("made") % 2 == 0, path(F.col("made"))))
    return joins.reconcile(lines, manifest, present, ["o_custkey"]).select("o_custkey", "made", "state", F.when(F.col("state") == "missing", F.col("reason")).alias("reason"))


@query(f"""WITH {HAPPENINGS}, e AS (SELECT user_id, max(moment) AS edited FROM happenings WHERE event_type = 'error' GROUP BY 1), p AS (SELECT user_id, max(moment) AS produced FROM happenings WHERE event_type = 'purchase' GROUP BY 1)
    SELECT user_id, edited, produced FROM e JOIN p USING (user_id) WHERE edited > produced""")
def pending_reprocess(spark, sf_dir):
    rows = happenings(spark, sf_dir)
    return joins.pending(rows.where("event_type = 'error'"), rows.where("event_type = 'purchase'"), ["user_id"], "moment")


@query("""SELECT p_partkey, p_name, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_type = 'ECONOMY' AND p_size < 3) THEN 'matched' WHEN p_size > 40 THEN 'hinted' ELSE 'new' END AS state FROM part""")
def matched_or_new(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    known = parts.where("p_type = 'ECONOMY' AND p_size < 3").select(F.col("p_name").alias("cue"))
    return joins.matched_or_new(parts.select("p_partkey", "p_name", "p_size"), known, "p_name", F.col("p_size") > 40).drop("p_size")


@query("""WITH e AS (SELECT p_partkey, p_name, CAST(p_partkey AS VARCHAR) AS n FROM part), a AS (SELECT DISTINCT upper(split_part(p_name, ' ', 2)) || '-' || CAST(p_size AS VARCHAR) AS asset_id FROM part)
    SELECT p_partkey, asset_id FROM e JOIN a ON upper(p_name || '-' || n) LIKE '% ' || asset_id OR upper(split_part(p_name, ' ', 2) || '-' || n) = asset_id""")
def cue_assets(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    assets = parts.select(F.concat_ws("-", F.upper(F.substring_index("p_name", " ", -1)), F.col("p_size").cast("string")).alias("asset_id")).distinct()
    named = parts.select("p_partkey", F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("cue"))
    return joins.contains_join(named, assets, F.col("cue"), "asset_id").where(F.upper("cue").endswith(F.concat(F.lit(" "), "asset_id"))).select("p_partkey", "asset_id")


_NAMES = [("the", "the", 0), ("the the", "twice", 1), ("la", "la", 2), ("de", "de", 3), ("de la", "de_la", 4), ("der", "der", 5), ("of", "of", 6)]


@query(r"""WITH l AS (SELECT conv_id, turn, lower(text) AS line FROM conversations), n(display, key, place) AS (VALUES ('the', 'the', 0), ('the the', 'twice', 1), ('la', 'la', 2), ('de', 'de', 3), ('de la', 'de_la', 4), ('der', 'der', 5), ('of', 'of', 6)),
    m AS (SELECT conv_id, turn, key, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(display) DESC, place) AS k FROM l JOIN n ON starts_with(line, display) AND (length(line) = length(display) OR substr(line, length(display) + 1, 1) IN (' ', '(')))
    SELECT conv_id, turn, key AS speaker FROM l LEFT JOIN (SELECT * FROM m WHERE k = 1) m USING (conv_id, turn)""")
def speaker_prefix(spark, sf_dir):
    lines = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("line")).withColumn("line_id", F.struct("conv_id", "turn"))
    return joins.speaker_of_line(lines, spark.createDataFrame(_NAMES, "display string, key string, place int")).select("conv_id", "turn", "speaker")


@query("""WITH e AS (SELECT p_name AS cue, min(p_partkey) AS pos FROM part GROUP BY 1), x AS (SELECT regexp_replace(cue, ' ', ' - ') AS plain, min(pos) AS found FROM e GROUP BY 1)
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN e.pos ELSE x.found END AS effect FROM part LEFT JOIN e ON p_name = cue LEFT JOIN x ON regexp_replace(p_name, ' ', ' - ') = plain""")
def effect_lookup(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    dash = lambda mark: F.regexp_replace("p_name", " ", mark)
    effects = parts.groupBy(dash(" – ").alias("cue")).agg(F.min("p_partkey").alias("at")).withColumn("effect", F.col("at"))
    plans = parts.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, dash(" – ")).otherwise(dash("—")).alias("cue_text"))
    return joins.find_effect(plans, effects, "cue_text").select("p_partkey", "effect")


# Sequences


@query("""WITH f AS (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN 's' || event_id END IGNORE NULLS) OVER w AS section,
        count(CASE WHEN event_type = 'signup' THEN 1 END) OVER w AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, user_id, section, last_value(CASE WHEN event_type = 'click' THEN 'c' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS scene FROM f""")
def section_ffill(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    mark = lambda kind, letter: F.when(F.col("event_type") == kind, F.concat(F.lit(letter), F.col("event_id").cast("string")))
    return sequence.fill_sections(rows, ["user_id"], ["event_id"], mark("signup", "s"), mark("click", "c")).drop("event_type")


@query(f"""WITH {TURNS}, r AS (SELECT *, count(CASE WHEN speaker = 'user' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM turns)
    SELECT conv_id, run, min(seq) AS seq, count(*) AS lines, string_agg(text, ' ' ORDER BY seq) AS text FROM r WHERE run > 0 GROUP BY 1, 2""")
def continuation_merge(spark, sf_dir):
    return sequence.merge_continuations(turns(spark, sf_dir), ["conv_id"], "seq", F.col("speaker") == "user", "text")


@query("SELECT event_id, user_id, count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events")
def run_index(spark, sf_dir):
    return sequence.number_runs(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") == "error").select("event_id", "user_id", "run")


@query("""WITH r AS (SELECT *, count(CASE WHEN event_type IN ('view', 'error') THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS record FROM events),
    m AS (SELECT *, min(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id, record) AS middle_at FROM r)
    SELECT user_id, record, max(CASE WHEN event_type = 'view' THEN event_id END) AS start_at, min(middle_at) AS middle_at, min(CASE WHEN event_type = 'purchase' AND event_id > middle_at THEN event_id END) AS end_at
    FROM m GROUP BY 1, 2 HAVING bool_or(event_type = 'view') AND end_at IS NOT NULL""")
def record_assembly(spark, sf_dir):
    kind = lambda name: F.col("event_type") == name
    return sequence.assemble_records(read(spark, sf_dir, "events"), ["user_id"], "event_id", kind("view"), kind("click"), kind("purchase"), kind("error"), {"start_at": F.col("event_id")})


@query(f"""WITH {TURNS}, b AS (SELECT conv_id, seq - 1 AS seq, speaker, 0 AS part, seq - 1 AS pos FROM turns UNION ALL SELECT conv_id, 1, 'note', 1, 1 FROM turns WHERE seq = 2)
    SELECT conv_id, CASE WHEN seq <= 0 THEN seq ELSE row_number() OVER (PARTITION BY conv_id, seq > 0 ORDER BY pos, part, seq) END AS seq, speaker FROM b""")
def renumber_splice(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", (F.col("seq") - 1).alias("seq"), "speaker")
    new = rows.select("conv_id").distinct().select("conv_id", F.lit(1).cast("long").alias("seq"), F.lit("note").alias("speaker"))
    return sequence.splice(rows, new, ["conv_id"], "seq", 1)


@query(f"WITH {TURNS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS seq, speaker FROM turns WHERE seq NOT BETWEEN 2 AND 3")
def renumber_delete(spark, sf_dir):
    return sequence.delete_range(turns(spark, sf_dir).select("conv_id", "seq", "speaker"), ["conv_id"], "seq", 2, 3)


_DEPTH = """WITH d AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS depth FROM events WHERE event_type IN ('signup', 'error')),
    l AS (SELECT *, least(0, coalesce(min(depth) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low,
        min(depth) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM d)
    SELECT event_id, user_id, CASE WHEN event_type = 'signup' THEN 'open' ELSE 'close' END AS kind FROM l WHERE CASE WHEN event_type = 'error' THEN depth < low ELSE later IS NULL OR later >= depth END"""


@query(_DEPTH)
def pairing_unmatched(spark, sf_dir):
    found = sequence.unpaired_markers(read(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "signup", F.col("event_type") == "error")
    return found.select("event_id", "user_id", "kind")


@query("""WITH m AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events WHERE event_type IN ('signup', 'error'))
    SELECT event_id, user_id FROM m WHERE event_type = 'signup' AND coalesce(after, 'signup') = 'signup'""")
def ambience_unclosed(spark, sf_dir):
    found = sequence.unclosed_loops(read(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "signup", F.col("event_type") == "error")
    return found.select("event_id", "user_id")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY 2")
def first_occurrence(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return sequence.first_of(rows, ["digest"], ["doc_id"])


# Timelines


@query(f"""WITH {ITEMS} SELECT l_orderkey, seq, CAST(coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity * 1000 AS BIGINT) + 600 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM items""")
def timeline_offsets(spark, sf_dir):
    found = timeline.offsets(items(spark, sf_dir), ["l_orderkey"], "seq", (F.col("l_quantity") * 1000).cast("long"), F.col("l_returnflag") == "R", gap=600)
    return found.select("l_orderkey", "seq", "start_ms")


@query(f"""WITH {HAPPENINGS}, v AS (SELECT *, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS label, max(moment) OVER (PARTITION BY user_id) AS total FROM happenings),
    n AS (SELECT *, coalesce(lag(label) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM label, true) AS fresh FROM v), i AS (SELECT *, count(CASE WHEN fresh THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM n),
    p AS (SELECT user_id, island, min(label) AS label, arg_min(moment, event_id) FILTER (value > 5) AS start_ms, max(total) AS total FROM i WHERE label <> '' GROUP BY 1, 2 HAVING start_ms IS NOT NULL),
    e AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY user_id ORDER BY island), total) AS end_ms FROM p) SELECT user_id, label, start_ms, end_ms FROM e WHERE end_ms > start_ms""")
def structure_bands(spark, sf_dir):
    rows = happenings(spark, sf_dir).withColumn("label", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))).withColumn("total", F.max("moment").over(Window.partitionBy("user_id")))
    return timeline.bands(rows.withColumn("start", F.when(F.col("value") > 5, F.col("moment"))), ["user_id"], "event_id", "label", "start", F.col("total"))


@query("""WITH s AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN 0 END IGNORE NULLS) OVER w AS film, last_value(CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'purchase' THEN 0 END IGNORE NULLS) OVER w AS phone
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, user_id, concat_ws(',', CASE WHEN film = 1 THEN 'film' END, CASE WHEN phone = 1 AND value > 10 THEN 'phone' END) AS spans FROM s WHERE event_type = 'view'""")
def active_spans(spark, sf_dir):
    kind = lambda name: F.col("event_type") == name
    spans = {"film": (kind("signup"), kind("error"), F.lit(True)), "phone": (kind("click"), kind("purchase"), F.col("value") > 10)}
    return timeline.active_spans(read(spark, sf_dir, "events"), ["user_id"], "event_id", spans).where(kind("view")).select("event_id", "user_id", F.array_join("spans", ",").alias("spans"))


@query(f"""WITH {HAPPENINGS}, m AS (SELECT user_id, max(moment) AS total FROM happenings GROUP BY 1), v AS (SELECT * FROM happenings WHERE event_type = 'view'), c AS (SELECT user_id, moment FROM happenings WHERE event_type = 'error')
    SELECT v.event_id, v.user_id, least(coalesce(c.moment, total), total) AS loop_end FROM v JOIN m USING (user_id) ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.moment < c.moment""")
def loop_end_asof(spark, sf_dir):
    rows = happenings(spark, sf_dir).withColumn("total", F.max("moment").over(Window.partitionBy("user_id")))
    found = timeline.loop_ends(rows, ["user_id"], "event_id", "moment", F.col("event_type") == "view", F.col("event_type") == "error", F.col("total"))
    return found.select("event_id", "user_id", "loop_end")


# Merges


@query("""WITH f AS (SELECT user_id, json_extract_string(props, '$.k') AS field, CASE WHEN value < 3 THEN NULL ELSE event_type END AS value, event_id, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts DESC, event_id DESC) AS k,
        count(*) OVER (PARTITION BY user_id, json_extract_string(props, '$.k')) AS edits FROM events) SELECT user_id, field, value, edits FROM f WHERE k = 1""")
def journal_replay(spark, sf_dir):
    changes = read(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("field"), F.when(~(F.col("value") < 3), F.col("event_type")).alias("value"), "ts", "event_id")
    return merge.last_values(changes, ["user_id", "field"], ["ts", "event_id"], "value")


@query("""WITH o AS (SELECT *, month(o_orderdate) % 2 AS half FROM orders), old AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM o WHERE half = 0),
    new AS (SELECT o_custkey, max(o_orderkey) AS "at", arg_max(o_orderstatus, o_orderkey) AS status FROM o WHERE half = 1 GROUP BY 1)
    SELECT coalesce(old.o_custkey, new.o_custkey) AS o_custkey, coalesce(old.o_orderkey, new."at") AS "at", coalesce(new.status, old.o_orderstatus) AS status, CASE WHEN new."at" IS NULL THEN 'kept' WHEN old.o_orderkey IS NULL THEN 'inserted' ELSE 'updated' END AS state
    FROM old FULL JOIN new ON old.o_custkey = new.o_custkey AND old.k = 1""")
def manifest_upsert(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"), (F.month("o_orderdate") % 2).alias("half"))
    return merge.upsert(rows.where("half = 0").drop("half"), rows.where("half = 1").drop("half"), ["o_custkey"], ["status"])


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS source FROM part WHERE p_partkey % 4 <> 0), h AS (SELECT l_partkey AS p_partkey, min(l_returnflag) AS hint FROM lineitem GROUP BY 1)
    SELECT coalesce(c.p_partkey, h.p_partkey) AS p_partkey, CASE WHEN nullif(source, '') IS NULL THEN coalesce(hint, source) ELSE source END AS source,
        CASE WHEN c.p_partkey IS NULL THEN 'insert' WHEN hint IS NULL OR source = hint THEN 'keep' WHEN source = '' THEN 'fill' ELSE 'keep' END AS action FROM c FULL JOIN h USING (p_partkey)""")
def merge_backfill(spark, sf_dir):
    config = read(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("source"))
    hints = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_returnflag").alias("source"))
    return merge.backfill(config, hints, "p_partkey", "source")


_PLAN = """WITH e AS (SELECT o_custkey AS doc, o_orderkey AS seq, o_orderstatus AS text, CASE WHEN o_orderpriority < '3' THEN 'a' ELSE 'b' END AS speaker, CASE WHEN o_orderpriority = '5-LOW' THEN 'scene_header' ELSE 'dialogue' END AS type, month(o_orderdate) % 2 AS half FROM orders),
    o AS (SELECT * FROM e WHERE half = 0 AND type = 'dialogue'), n AS (SELECT * FROM e WHERE half = 1),
    a AS (SELECT doc, text, arg_min(speaker, seq) AS any_speaker, min(seq) AS any_seq FROM o GROUP BY 1, 2), s AS (SELECT doc, text, speaker, min(seq) AS same FROM o GROUP BY 1, 2, 3),
    m AS (SELECT n.*, same, any_speaker, any_seq, n.type = 'dialogue' AND same IS NOT NULL AND row_number() OVER (PARTITION BY doc, text, speaker, n.type ORDER BY seq) = 1 AS exact FROM n LEFT JOIN a USING (doc, text) LEFT JOIN s USING (doc, text, speaker)),
    u AS (SELECT *, exact OR (type = 'dialogue' AND any_seq IS NOT NULL) AS uses FROM m),
    b AS (SELECT *, coalesce(count(CASE WHEN uses THEN 1 END) OVER (PARTITION BY doc, text ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
    SELECT doc, seq, CASE WHEN type <> 'dialogue' THEN 'SKIP' WHEN exact THEN 'EXACT' WHEN uses AND before = 0 AND any_speaker <> speaker THEN 'SPEAKER' ELSE 'NEW' END AS status,
        CASE WHEN type <> 'dialogue' THEN NULL WHEN exact THEN same WHEN uses AND before = 0 AND any_speaker <> speaker THEN any_seq END AS old_seq FROM b"""


@query(_PLAN)
def migrate_plan(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("text"), F.when(F.col("o_orderpriority") < "3", "a").otherwise("b").alias("speaker"),
        F.when(F.col("o_orderpriority") == "5-LOW", "scene_header").otherwise("dialogue").alias("type"), (F.month("o_orderdate") % 2).alias("half"),
    )
    return merge.migration_plan(rows.where("half = 0").drop("half"), rows.where("half = 1").drop("half"), ["doc"]).select("doc", "seq", "status", "old_seq")


# Matching


_MATCH = """WITH c AS (SELECT DISTINCT p_name AS cue, list_filter(list_distinct(string_split(p_name, ' ')), lambda x: x <> 'new') AS ct FROM part),
    a AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS asset, list_filter(list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')), lambda x: x <> 'new') AS toks FROM part),
    s AS (SELECT cue, asset, len(list_intersect(ct, toks)) / len(ct) AS coverage, len(list_intersect(ct, toks)) / len(list_distinct(list_concat(ct, toks))) AS jaccard FROM c, a),
    r AS (SELECT *, coverage + 0.25 * jaccard AS score, row_number() OVER (PARTITION BY cue ORDER BY coverage + 0.25 * jaccard DESC, asset) AS rank FROM s WHERE coverage >= 0.5),
    m AS (SELECT *, score - lead(score, 1, 0.0) OVER (PARTITION BY cue ORDER BY rank) AS margin FROM r)
    SELECT cue, asset, coverage, jaccard, score, CAST(rank AS INTEGER) AS rank, max(CASE WHEN rank = 1 THEN CASE WHEN coverage >= 0.8 AND jaccard >= 0.4 AND margin >= 0.15 THEN 'STRONG' ELSE 'REVIEW' END END) OVER (PARTITION BY cue) AS tier FROM m WHERE rank <= 3"""


@query(_MATCH)
def token_match_topk(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    cues = parts.select(F.col("p_name").alias("cue")).distinct().withColumns({"cue_tokens": t.tokens(F.col("cue")), "placement": t.placement(F.col("cue"))})
    pool = parts.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("asset")).distinct().withColumns({"asset_tokens": t.tokens(F.col("asset")), "placement": t.file_placement(F.col("asset"))})
    return matching.ranked_matches(matching.candidates(cues, pool), cues)


@query("""WITH a AS (SELECT 'n' || s_nationkey AS filename, CASE s_suppkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN '' ELSE 'other' END AS scope, s_suppkey AS "at" FROM supplier)
    SELECT filename, scope, "at" FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY CASE scope WHEN 'own' THEN 0 WHEN '' THEN 1 ELSE 2 END, "at") AS k FROM a) WHERE k = 1""")
def exact_index(spark, sf_dir):
    scope = F.when(F.col("s_suppkey") % 3 == 0, "own").when(F.col("s_suppkey") % 3 == 1, "").otherwise("other")
    assets = read(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("filename"), scope.alias("scope"), F.col("s_suppkey").alias("at"))
    return matching.exact_index(assets, "own")


_IMPACT = """WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS nat, l_returnflag = 'R' AS looped, CASE WHEN l_linestatus = 'O' AND l_discount > 0.05 THEN l_discount * 1000 END AS pct, l_tax * 500 AS dur FROM lineitem),
    p AS (SELECT *, NOT looped AND pct IS NULL AND dur > 0 AS clip, CASE WHEN looped THEN nat WHEN pct IS NOT NULL THEN nat * pct / 100 WHEN dur > 0 THEN least(dur, nat) ELSE nat END AS plays FROM i),
    d AS (SELECT *, greatest(nat - plays, 0.0) AS delta_s, CASE WHEN NOT clip THEN 'EXCLUDED' WHEN nat - least(dur, nat) < 0.1 THEN '1-nochange' WHEN nat - least(dur, nat) < 3.0 THEN '2-minor' ELSE '3-review' END AS tier FROM p)"""


def _impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = F.when((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.05), F.col("l_discount") * 1000)
    rows = read(spark, sf_dir, "lineitem").withColumn("cue", F.lit("SFX: DOOR"))
    return impact.cue_impact(rows, F.col("l_quantity"), F.col("l_returnflag") == "R", percent, F.col("l_tax") * 500)


@query(f"{_IMPACT} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, plays AS plays_now_s, delta_s, tier FROM d")
def impact_tiers(spark, sf_dir):
    return _impacts(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "plays_now_s", "delta_s", "tier")


@query(f"{_IMPACT} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, delta_s FROM d WHERE tier IN ('2-minor', '3-review') ORDER BY delta_s DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10")
def worst_offenders(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return _impacts(spark, sf_dir).where(F.col("tier").isin("2-minor", "3-review")).orderBy(F.desc("delta_s"), *keys).limit(10).select(*keys, "delta_s")


# Text


_CUE = "CASE p_type WHEN 'ECONOMY' THEN 'AMBIENCE: ' WHEN 'PROMO' THEN 'MUSIC: ' WHEN 'SMALL' THEN 'BEAT ' WHEN 'LARGE' THEN 'INTRO MUSIC' WHEN 'MEDIUM' THEN 'PHONE FILTER ' ELSE 'NIGHT MUSIC: ' END || p_name"


@query(f"""WITH c AS (SELECT p_partkey, {_CUE} AS cue FROM part) SELECT p_partkey, CASE WHEN starts_with(upper(cue), 'MUSIC') OR starts_with(upper(cue), 'INTRO MUSIC') OR contains(split_part(upper(cue), ':', 1), ' MUSIC') THEN 'MUSIC(bg)'
    WHEN starts_with(upper(cue), 'AMBIEN') THEN 'AMBI(bg)' WHEN starts_with(upper(cue), 'BEAT') THEN 'BEAT(fg)' ELSE 'SFX(fg)' END AS placement,
    CASE WHEN starts_with(cue, 'MUSIC') THEN 'MUSIC' WHEN starts_with(cue, 'AMBIENCE') THEN 'AMBIENCE' WHEN starts_with(cue, 'BEAT') THEN 'BEAT' WHEN starts_with(cue, 'PHONE FILTER') THEN 'PHONE FILTER' END AS kind,
    CASE WHEN starts_with(cue, 'AMBIENCE:') THEN 30.0 WHEN starts_with(cue, 'MUSIC:') THEN 15.0 ELSE 5.0 END::DOUBLE AS seconds FROM c""")
def placement_class(spark, sf_dir):
    cue = F.expr(_CUE)
    return read(spark, sf_dir, "part").select("p_partkey", t.placement(cue).alias("placement"), t.direction_type(cue).alias("kind"), t.default_duration(cue).alias("seconds"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(lower(url), ': ', '_'), '[^a-z0-9_]+', '-', 'g'), '-{2,}', '-', 'g'), '-') AS slug, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS show_slug,
    CASE WHEN page_id % 3 = 0 THEN printf('E%02d', page_id) ELSE printf('S%02dE%02d', page_id % 7, page_id) END AS tag FROM pages""")
def slugify(spark, sf_dir):
    season = F.when(F.col("page_id") % 3 != 0, F.col("page_id") % 7)
    return read(spark, sf_dir, "pages").select("page_id", t.effect_slug(F.col("url")).alias("slug"), t.show_slug(F.col("url")).alias("show_slug"), t.episode_tag(season, F.col("page_id")).alias("tag"))


_HEADER = "CASE WHEN page_id % 5 = 0 THEN 'No numbers here' WHEN page_id % 5 = 1 THEN concat('Late Hour Episode ', page_id, ': The ', page_id, 'th') ELSE concat('Late Hour Season ', page_id % 9, ' Episode ', page_id, ': \"Night ', page_id, '\" Arc: \"Rain\"') END"


@query(f"""WITH h AS (SELECT page_id, {_HEADER} AS line FROM pages) SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN 'Late Hour' END AS "show", CASE WHEN page_id % 5 > 1 THEN CAST(page_id % 9 AS BIGINT) END AS season, CASE WHEN page_id % 5 <> 0 THEN CAST(page_id AS BIGINT) END AS episode,
    CASE WHEN page_id % 5 = 1 THEN concat('The ', page_id, 'th') WHEN page_id % 5 > 1 THEN concat('Night ', page_id) END AS title, CASE WHEN page_id % 5 > 1 THEN 'Rain' END AS season_title, CAST(page_id AS BIGINT) AS stem_seq FROM h""")
def header_extract(spark, sf_dir):
    header = t.script_header(F.expr(_HEADER))
    stem = t.stem_seq(F.concat(F.lit("stems/x/"), F.format_string("%03d", "page_id"), F.lit("_act1_adam.mp3")))
    return read(spark, sf_dir, "pages").select("page_id", header.alias("h"), stem.alias("stem_seq")).select("page_id", "h.*", "stem_seq")


_CAPS = r"length(line) BETWEEN 2 AND 79 AND line = upper(line) AND NOT regexp_matches(line, '^(={3,}|-{3,})$') AND NOT (starts_with(line, '[') AND contains(line, ']')) AND NOT regexp_matches(line, '^SCENE \d+[A-Za-z]*:') AND NOT suffix(line, ':')"
_LINES = r"lines AS (SELECT doc_id AS doc, regexp_replace(u.raw, '^\s+|\s+$', '', 'g') AS line, u.line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) u)"


@query(f"WITH {_LINES} SELECT doc, count(*) AS lines, count(*) FILTER (line = '') AS blank, count(*) FILTER (regexp_matches(line, '^(={{3,}}|-{{3,}})$')) AS dividers, count(*) FILTER (starts_with(line, '[') AND contains(line, ']')) AS directions, count(*) FILTER ({_CAPS}) AS caps FROM lines GROUP BY 1")
def line_classify(spark, sf_dir):
    rows = document_lines(spark, sf_dir).withColumn("line", t.strip(F.col("raw")))
    line = F.col("line")
    return rows.groupBy("doc").agg(F.count("*").alias("lines"), F.count_if(line == "").alias("blank"), F.count_if(t.is_divider(line)).alias("dividers"), F.count_if(t.is_stage_direction(line)).alias("directions"), F.count_if(t.is_caps_candidate(line)).alias("caps"))


@query(f"WITH {_LINES} SELECT doc, line, count(*) AS uses, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS line_nos FROM lines WHERE line <> '' AND {_CAPS} GROUP BY 1, 2")
def caps_harvest(spark, sf_dir):
    return scripts.caps_lines(document_lines(spark, sf_dir)).withColumn("line_nos", F.array_join(F.col("line_nos").cast("array<string>"), ","))


@query("""WITH f AS (SELECT conv_id, turn, role, count(*) OVER () AS total FROM conversations WHERE contains(lower(text), 'tion') OR contains(lower(role), 'tion')) SELECT * FROM f ORDER BY conv_id, turn, role LIMIT 25 OFFSET 25""")
def search_page(spark, sf_dir):
    found = read(spark, sf_dir, "conversations").where(F.lower("text").contains("tion") | F.lower("role").contains("tion")).select("conv_id", "turn", "role")
    return found.join(F.broadcast(found.agg(F.count("*").alias("total")))).orderBy("conv_id", "turn", "role").offset(25).limit(25)


@query("SELECT user_id AS tag FROM events UNION SELECT o_custkey FROM orders UNION SELECT doc_id FROM labels")
def tag_union(spark, sf_dir):
    tags = [("events", "user_id"), ("orders", "o_custkey"), ("labels", "doc_id")]
    parts = [read(spark, sf_dir, name).select(F.col(c).alias("tag")).distinct() for name, c in tags]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("SELECT doc_id, sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))


_HINT = "concat('SFX: ', p_name, CASE WHEN p_size % 2 = 0 THEN ' | door.mp3' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN concat(' | play_volume_pct=', p_size * 10, '%') ELSE '' END, CASE WHEN p_size % 5 = 0 THEN ' | softly' ELSE '' END)"


@query("""SELECT p_partkey, concat('SFX: ', p_name, CASE WHEN p_size % 3 = 0 AND p_size > 20 THEN concat(' | play_volume_pct=', p_size * 10, '%') ELSE '' END, CASE WHEN p_size % 5 = 0 THEN ' | softly' ELSE '' END) AS clean,
    CASE WHEN p_size % 2 = 0 THEN 'SFX/show/door.mp3' END AS source, CASE WHEN p_size % 3 = 0 AND p_size <= 20 THEN CAST(p_size * 10 AS DOUBLE) END AS volume FROM part""")
def pipe_hints(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", t.split_hints(F.expr(_HINT), F.lit("show")).alias("h"))
    return parts.select("p_partkey", "h.clean", "h.source", F.col("h.overrides")["volume_percentage"].alias("volume"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity - 1 <= 0 THEN CAST('-inf' AS DOUBLE) ELSE round(20 * log10((l_quantity - 1) / 100), 6) END AS db, printf('%d:%02d', CAST(floor(floor(l_extendedprice) / 60) AS BIGINT), CAST(floor(l_extendedprice) AS BIGINT) % 60) AS clock FROM lineitem""")
def volume_clock(spark, sf_dir):
    percent = F.col("l_quantity") - 1
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(percent <= 0, t.volume_db(percent)).otherwise(t.rounded(t.volume_db(percent), 6)).alias("db"), t.clock(F.col("l_extendedprice")).alias("clock"))


# What SQL cannot say


@query()
def similarity_compare(spark, sf_dir):
    """How much each turn is like the one before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("seq"))
    rows = turns(spark, sf_dir).withColumn("before", before).where("before IS NOT NULL")
    return rows.select("conv_id", "seq", round_exact(similarity(t.spoken_text(F.col("before")), t.spoken_text(F.col("text"))), F.lit(4)).alias("similarity"))


_PARSE = r"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS doc, u.at AS line_no, regexp_replace(replace(regexp_replace(u.raw, '^#{1,6}\s*', ''), '**', ''), '^\s+|\s+$', '', 'g') AS line
        FROM (SELECT doc_id, unnest(string_split(nfc_normalize(text), chr(10))) AS raw, generate_subscripts(string_split(nfc_normalize(text), chr(10)), 1) AS at FROM documents) u),
    n AS (SELECT *, regexp_extract(line, '^(The|La|De|Der|Of)([ (]|$)', 1) AS name FROM l WHERE line <> ''),
    w AS (SELECT *, ltrim(substr(line, length(name) + 1)) AS rest, starts_with(line, '(') AND suffix(line, ')') AS aside FROM n),
    k AS (SELECT *, CASE WHEN name <> '' AND regexp_matches(rest, '^\([^)]*\)') THEN trim(regexp_extract(rest, '^\(([^)]*)\)', 1)) END AS note, CASE WHEN name = '' THEN NULL ELSE trim(regexp_replace(rest, '^\([^)]*\)', '')) END AS words FROM w),
    c AS (SELECT *, CASE WHEN regexp_matches(line, '^(={3,}|-{3,})$') THEN 'other' WHEN words = '' THEN 'name' WHEN words IS NOT NULL THEN 'said' WHEN aside THEN 'other' ELSE 'plain' END AS kind FROM k),
    r AS (SELECT *, kind = 'name' AND lag(kind, 1, '') OVER o <> 'name' AS fresh FROM c WHERE NOT aside WINDOW o AS (PARTITION BY doc ORDER BY line_no)),
    g AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM r),
    p AS (SELECT *, kind = 'name' AND row_number() OVER (PARTITION BY doc, run ORDER BY line_no) % 2 = 1 AS waits FROM g),
    q AS (SELECT doc, line_no, line, note, words, name, CASE WHEN lag(waits, 1, false) OVER o THEN 'taken' ELSE kind END AS kind FROM p WINDOW o AS (PARTITION BY doc ORDER BY line_no)),
    e AS (SELECT *, count(*) FILTER (kind IN ('name', 'said', 'taken')) OVER o AS event, last_value(CASE WHEN kind = 'name' THEN name END IGNORE NULLS) OVER o AS of_name, last_value(CASE WHEN kind = 'name' THEN coalesce(note, '') END IGNORE NULLS) OVER o AS of_note
        FROM q WINDOW o AS (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT doc, min(line_no) AS line_no, arg_min(kind, line_no) AS kind, arg_min(CASE WHEN kind = 'taken' THEN of_name ELSE name END, line_no) AS name, arg_min(CASE WHEN kind = 'taken' THEN nullif(of_note, '') ELSE note END, line_no) AS direction,
        string_agg(CASE WHEN kind = 'said' THEN words ELSE line END, ' ' ORDER BY line_no) AS text FROM e WHERE event > 0 AND kind <> 'other' GROUP BY doc, event)
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS seq, 'dialogue' AS type, lower(name) AS speaker, direction, text, line_no FROM d WHERE kind <> 'name'"""


@query(_PARSE)
def parse_script(spark, sf_dir):
    """Documents read as scripts whose speakers are a few frequent words."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.col("text").alias("value"))
    return scripts.parse_scripts(docs, [("The", "the"), ("La", "la"), ("De", "de"), ("Der", "der"), ("Of", "of")]).select("doc", "seq", "type", "speaker", "direction", "text", "line_no")


@query("""SELECT p_partkey, nfc_normalize(p_name || chr(101) || chr(769)) AS composed, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title,
    printf('%g', p_retailprice) AS price, CAST(printf('%.2f', p_retailprice / 7) AS DOUBLE) AS seventh FROM part""")
def exact_scalars(spark, sf_dir):
    """Composition, title case, short numbers and exact rounding of parts."""
    accent = F.lit("e\u0301")
    return read(spark, sf_dir, "part").select("p_partkey", nfc(F.concat("p_name", accent)).alias("composed"), title_case("p_name").alias("title"), short_number("p_retailprice").alias("price"), round_exact(F.col("p_retailprice") / 7, F.lit(2)).alias("seventh"))


# The longest common block of a window of two words, the first one in the choice, then in the word; windows left and right of it follow.
_BEST = """list_max(flatten(list_transform(range({a0}, {a1}), lambda i: list_transform(range({b0}, {b1}), lambda j:
        {{'k': coalesce(list_max(list_filter(range(1, least({a1} - i, {b1} - j) + 1), lambda k: substr(choice, i + 1, k) = substr(word, j + 1, k))), 0), 'i': -i, 'j': -j}}))))"""
_NEAREST = f"""met AS (SELECT word, choice, length(choice) AS n, length(word) AS m FROM words, names WHERE word <> choice AND 2.0 * least(n, m) / (n + m) >= 0.72),
    blocks AS (SELECT word, choice, 0::BIGINT AS a0, n::BIGINT AS a1, 0::BIGINT AS b0, m::BIGINT AS b1, {_BEST.format(a0=0, a1="n", b0=0, b1="m")} AS best FROM met
        UNION ALL
        SELECT word, choice, c0, c1, d0, d1, {_BEST.format(a0="c0", a1="c1", b0="d0", b1="d1")} FROM (
            SELECT word, choice, unnest([a0, best.k - best.i]) AS c0, unnest([-best.i, a1]) AS c1, unnest([b0, best.k - best.j]) AS d0, unnest([-best.j, b1]) AS d1
            FROM blocks WHERE best.k > 0) WHERE c0 < c1 AND d0 < d1),
    near AS (SELECT word, choice, 2.0 * sum(best.k) / (length(word) + length(choice)) AS ratio FROM blocks GROUP BY word, choice
        UNION ALL SELECT word, choice, 1.0 FROM words JOIN names ON word = choice),
    nearest AS (SELECT word, max(struct_pack(ratio := ratio, choice := choice)) AS best FROM near WHERE ratio >= 0.72 GROUP BY word)"""


@query(f"""WITH RECURSIVE words AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)),
    names AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS choice FROM part), {_NEAREST}
    SELECT word, best.choice AS choice, best.ratio AS ratio FROM nearest""")
def nearest_names(spark, sf_dir):
    """The word of a part's name that each word of the documents is most like."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    names = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("choice"))
    return nearest.nearest(words, names, "word", "choice")


@query(f"""WITH RECURSIVE said AS (SELECT conv_id, CAST(turn + 1 AS BIGINT) AS line_no, regexp_extract_all(text, '([a-zA-Z]+)\\.', 1) AS tags FROM conversations),
    tags AS (SELECT conv_id, line_no, unnest(tags) AS text, generate_subscripts(tags, 1) AS nth FROM said),
    names AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS choice FROM part),
    aliases AS (SELECT lower(regexp_extract(text, '[a-zA-Z]+')) AS name, 'ring' AS suggestion FROM benchmark GROUP BY 1),
    named AS (SELECT t.*, lower(t.text) AS name, a.suggestion AS alias FROM tags t LEFT JOIN aliases a ON a.name = lower(t.text) WHERE lower(t.text) NOT IN (SELECT choice FROM names)),
    words AS (SELECT DISTINCT name AS word FROM named WHERE alias IS NULL), {_NEAREST}
    SELECT conv_id, name, arg_min(text, line_no * 100000 + nth) AS text, any_value(coalesce(alias, best.choice)) AS suggestion, array_to_string(list(line_no ORDER BY line_no), ',') AS lines
    FROM named LEFT JOIN nearest ON word = name WHERE coalesce(alias, best.choice) IS NOT NULL GROUP BY conv_id, name""")
def near_miss_tags(spark, sf_dir):
    """The last words of sentences as tags of turns: those nearly like words of parts' names, or first words of benchmark passages, which stand for one of these."""
    raw = F.regexp_replace("text", r"([a-zA-Z]+)\.", "[$1]")
    lines = read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("long").alias("line_no"), raw.alias("raw"))
    names = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    aliases = read(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", "[a-zA-Z]+", 0)).alias("name")).distinct().withColumn("suggestion", F.lit("ring"))
    found = nearest.near_misses(lines, names, aliases, ["conv_id"])
    return found.withColumn("lines", F.array_join("lines", ","))


# Production


@query("""WITH f AS (SELECT l_orderkey AS folder, l_partkey || '/' || l_linenumber AS path, CAST(l_quantity AS BIGINT) AS size, epoch_us(l_shipdate) AS modified, l_returnflag = 'R' AS keep FROM lineitem),
    g AS (SELECT *, sum(size) OVER (PARTITION BY folder) AS total, coalesce(sum(CASE WHEN NOT keep THEN size END) OVER (PARTITION BY folder ORDER BY modified, size, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
    SELECT folder, path, size FROM g WHERE NOT keep AND total - before > 60""")
def eviction_plan(spark, sf_dir):
    files = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("folder"), F.concat_ws("/", "l_partkey", "l_linenumber").alias("path"), F.col("l_quantity").cast("long").alias("size"), F.col("l_shipdate").alias("modified"), (F.col("l_returnflag") == "R").alias("keep")
    )
    return production.eviction_plan(files, "folder", 60, F.col("keep")).select("folder", "path", "size")


@query(f"""WITH {TURNS}, c AS (SELECT *, count(CASE WHEN type = 'direction' THEN 1 END) OVER w AS chapter_no, coalesce(last_value(CASE WHEN type = 'direction' THEN text END IGNORE NULLS) OVER w, 'Untitled') AS chapter
        FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, chapter_no, chapter, seq, 'p' AS kind, CASE WHEN speaker = 'user' THEN 'v1' ELSE 'narrator' END AS voice_id, text FROM c WHERE type = 'dialogue'""")
def chapter_blocks(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("type", F.when(F.col("type") == "direction", "section_header").otherwise(F.col("type")))
    return production.chapters(rows, spark.createDataFrame([("user", "v1")], "speaker string, voice_id string"), ["conv_id"], "narrator")


@query("""WITH s AS (SELECT DISTINCT role AS speaker FROM conversations) SELECT speaker, CASE speaker WHEN 'user' THEN 'The Caller' ELSE upper(speaker[1]) || speaker[2:] END AS full_name,
    CASE speaker WHEN 'user' THEN 'v7' ELSE 'TBD' END AS voice_id, CASE speaker WHEN 'user' THEN 0.5 ELSE 0.0 END::DOUBLE AS pan, CASE speaker WHEN 'user' THEN 'phone' ELSE '' END AS filter, 'TBD' AS role FROM s""")
def cast_skeleton(spark, sf_dir):
    speakers = read(spark, sf_dir, "conversations").select(F.col("role").alias("speaker")).distinct()
    registry = spark.createDataFrame([("USER", "user", "The Caller", "", "v7", 0.5, "phone")], "display string, key string, full_name string, role string, voice_id string, pan double, filter string")
    return production.cast_skeleton(speakers, registry)


@query(f"""WITH e AS (SELECT p_size AS doc, p_partkey AS seq, {_CUE} AS cue, CASE WHEN p_retailprice < 950 THEN 'SFX/x/' || p_partkey || '.mp3' END AS src FROM part),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc, cue ORDER BY seq) AS k, CASE WHEN starts_with(cue, 'BEAT') THEN 1.0 WHEN starts_with(cue, 'PHONE FILTER') THEN 0.0 END AS quiet FROM e)
    SELECT doc, seq, cue, CASE WHEN quiet IS NULL THEN 'sfx' ELSE 'silence' END AS type, CASE WHEN quiet IS NULL THEN src END AS source, CASE WHEN quiet IS NULL AND src IS NULL THEN cue END AS prompt,
        CAST(coalesce(quiet, CASE WHEN starts_with(cue, 'AMBIENCE:') THEN 30.0 WHEN starts_with(cue, 'MUSIC:') THEN 15.0 ELSE 5.0 END) AS DOUBLE) AS seconds, quiet IS NULL AND starts_with(cue, 'AMBIENCE:') AS loop FROM f WHERE k = 1""")
def sound_skeleton(spark, sf_dir):
    source = F.when(F.col("p_retailprice") < 950, F.concat(F.lit("SFX/x/"), F.col("p_partkey").cast("string"), F.lit(".mp3")))
    rows = read(spark, sf_dir, "part").select(F.col("p_size").alias("doc"), F.col("p_partkey").alias("seq"), F.lit("direction").alias("type"), F.expr(_CUE).alias("text"), source.alias("sfx_source"))
    return production.sound_skeleton(rows, ["doc"])


# Cleaning, names, levels and keys


@query(r"""SELECT doc_id AS doc, u.at AS line_no, rtrim(replace(regexp_replace(u.raw, '^#{1,6}\s*', ''), '**', '')) AS line
    FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\(.)', '\1', 'g'), chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS at FROM documents) u""")
def script_cleanup(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(t.strip_escapes(F.col("text")), "\n")).alias("at", "raw"))
    return lines.select("doc", (F.col("at") + 1).cast("long").alias("line_no"), t.strip_formatting(F.col("raw")).alias("line"))


_SECTION = "CASE p_size % 6 WHEN 0 THEN concat('ACT TWO: ', p_name) WHEN 1 THEN concat(' CHAPTER ', p_size, ' ') WHEN 2 THEN 'INTRO' WHEN 3 THEN concat('SCENE ', p_size, 'a: ', p_name, ' [SFX: DOOR]') WHEN 4 THEN 'PRE-SHOW MUSIC' ELSE p_name END"


@query(f"""WITH l AS (SELECT p_partkey, p_size, p_name, {_SECTION} AS line FROM part) SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'act2' WHEN 1 THEN CASE WHEN p_size <= 30 THEN concat('chapter', p_size) END WHEN 2 THEN 'intro' WHEN 4 THEN 'preamble' END AS slug,
    CASE WHEN p_size % 6 = 3 THEN concat(p_size, 'a') END AS number, CASE WHEN p_size % 6 = 3 THEN concat(p_name, ' [SFX: DOOR]') END AS scene, CASE WHEN p_size % 6 = 3 THEN concat('SCENE ', p_size, 'a: ', p_name) ELSE trim(line) END AS bare FROM l""")
def section_headers(spark, sf_dir):
    line = F.expr(_SECTION)
    slug = t.section_slug(line, scripts.sections_of("special"))
    return read(spark, sf_dir, "part").select("p_partkey", slug.alias("slug"), t.scene_number(line).alias("number"), t.scene_name(line).alias("scene"), t.strip_brackets(line).alias("bare"))


@query(r"""WITH f AS (SELECT *, replace(text, chr(10), ' ') AS flat FROM documents) SELECT doc_id, array_to_string(regexp_extract_all(text, '\S+')[1:5], ' ') AS opening, CASE WHEN length(flat) > 55 THEN concat(substr(flat, 1, 55), '…') ELSE flat END AS shown,
    n_chars <> 0 AS has_text, lang <> '' AS has_lang FROM f""")
def snippets(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", t.first_words(F.col("text")).alias("opening"), t.snip(F.col("text")).alias("shown"), t.truthy(F.col("n_chars"), "bigint").alias("has_text"), t.truthy(F.col("lang"), "string").alias("has_lang"))


@query("""SELECT p_partkey, 'SFX/shared/' || replace(p_name, ' ', '-') || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '.stable' ELSE '.other' END || '.mp3' AS path, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS key FROM part""")
def effect_paths(spark, sf_dir):
    backend = F.when(F.col("p_size") % 3 == 0, "elevenlabs").when(F.col("p_size") % 3 == 1, "stable").otherwise("other")
    shown = F.concat(F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit(" (V.O.) "))
    return read(spark, sf_dir, "part").select("p_partkey", t.effect_path(F.lit("SFX/shared"), F.col("p_name"), backend).alias("path"), t.display_to_key(shown).alias("key"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount <= 0 THEN CAST('-inf' AS DOUBLE) ELSE round(20 * log10(l_discount), 6) END AS db, round(pow(10.0, (l_quantity - 25) / 20), 6) AS factor FROM lineitem""")
def mix_levels(spark, sf_dir):
    db = t.ratio_db(F.col("l_discount"))
    factor = t.db_factor(F.col("l_quantity") - 25)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_discount") <= 0, db).otherwise(t.rounded(db, 6)).alias("db"), t.rounded(factor, 6).alias("factor"))


@query("""WITH k AS (SELECT doc_id, sha256(concat_ws(chr(31), text, lang, source, '50', '0', 'a')) AS content_key FROM documents), m AS (SELECT content_key, max(doc_id) AS made FROM k WHERE doc_id % 3 <> 0 GROUP BY 1)
    SELECT doc_id, content_key, CASE WHEN made IS NULL OR made % 5 = 0 THEN 'missing' WHEN made = doc_id THEN 'correct' ELSE 'relink' END AS state FROM k LEFT JOIN m USING (content_key)""")
def reconcile_by_content(spark, sf_dir):
    """Lines against a manifest by what they are made of: text, voice, show and settings."""
    key = t.content_key(F.col("text"), F.col("lang"), F.col("source"), F.lit(50), F.lit(0), F.lit("a"))
    docs = read(spark, sf_dir, "documents").select("doc_id", key.alias("content_key"))
    path = lambda c: F.concat(F.lit("stems/"), F.col(c).cast("string"))
    made = docs.where("doc_id % 3 <> 0").select("content_key", F.col("doc_id").alias("at"), path("doc_id").alias("path"), F.lit("x").alias("sha256"))
    present = docs.where("doc_id % 5 <> 0").select(path("doc_id").alias("path"), F.lit("x").alias("sha256"))
    return joins.reconcile(docs.withColumn("expected_path", path("doc_id")), made, present, ["content_key"]).select("doc_id", "content_key", "state")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_type = 'ECONOMY' THEN NULL ELSE CAST(p_size AS DOUBLE) END AS plays, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size * 2 AS DOUBLE) END AS volume FROM part""")
def usable_overrides(spark, sf_dir):
    given = F.create_map(F.lit("play_duration"), F.col("p_size").cast("double"), F.lit("volume_percentage"), (F.col("p_size") * 2).cast("double"))
    found = t.allowed_overrides(F.expr(_CUE), F.col("p_size") % 4 == 0, given)
    return read(spark, sf_dir, "part").select("p_partkey", found["play_duration"].alias("plays"), found["volume_percentage"].alias("volume"))


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 'ENGAGES' WHEN 'error' THEN 'DISENGAGES' END AS marker, CASE WHEN event_type = 'signup' THEN 'u' || user_id END AS scope FROM events""")
def span_markers(spark, sf_dir):
    cue = F.when(F.col("event_type") == "signup", F.concat(F.lit("PHONE FILTER ENGAGES: U"), F.col("user_id").cast("string"))).when(F.col("event_type") == "error", "PHONE FILTER DISENGAGES").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", timeline.span_marker(cue).alias("marker"), F.when(timeline.span_marker(cue) == "ENGAGES", timeline.span_scope(cue)).alias("scope"))


@query("SELECT event_id, user_id, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS failed FROM events")
def failed_since(spark, sf_dir):
    return sequence.latch(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type") == "error", "failed").drop("event_type")


@query(f"""WITH {TURNS}, m AS (SELECT type, speaker, type = 'direction' AND conv_id % 2 = 0 AS sfx, type = 'dialogue' AND speaker = 'user' AS voiced FROM turns)
    SELECT count(*) AS "rows", count(*) FILTER (type = 'direction') AS directions, count(*) FILTER (sfx) AS sfx_matched, count(*) FILTER (type = 'dialogue') AS dialogue, count(*) FILTER (voiced) AS cast_matched FROM m""")
def match_summary(spark, sf_dir):
    """How many directions have an effect and how many lines a voice."""
    rows = turns(spark, sf_dir).withColumn("text", F.when(F.col("type") == "direction", F.concat("conv_id", F.lit("/"), "seq")).otherwise(F.col("text")))
    effect = "struct<type:string,prompt:string,duration_seconds:double,prompt_influence:double,loop:boolean>"
    effects = rows.where("type = 'direction' AND conv_id % 2 = 0").select(F.col("text").alias("cue"), F.lit(None).cast(effect).alias("effect"))
    cast = spark.createDataFrame([("user", "Caller", "v1", 0.0, "", "host")], "speaker string, full_name string, voice_id string, pan double, filter string, role string")
    return joins.match_counts(joins.annotate_entries(rows, effects, cast))


@query("""SELECT printf('%d:%04.1f', CAST(floor(p_size / 60) AS BIGINT), p_size - 60 * floor(p_size / 60)) || '  ' || printf('%d:%04.1f', CAST(floor((p_size + 40) / 60) AS BIGINT), p_size + 40 - 60 * floor((p_size + 40) / 60)) || '  ' || rpad('music', 9, ' ') || '  ' || p_name AS value FROM part""")
def timeline_map(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    return timeline.text_map(timeline.layer(parts, "music", F.col("p_size").cast("double"), (F.col("p_size") + 40).cast("double"), F.col("p_name")), "p_partkey")


@query("""WITH c AS (SELECT DISTINCT p_name AS cue FROM part), x AS (SELECT cue FROM c WHERE length(cue) % 2 = 0) SELECT cue, CASE WHEN cue IN (SELECT cue FROM x) THEN 'EXACT' ELSE 'NONE' END AS tier, CASE WHEN cue IN (SELECT cue FROM x) THEN cue || '!' END AS asset FROM c""")
def exact_first(spark, sf_dir):
    """Cues whose own file is there, before any that are only like it."""
    cues = read(spark, sf_dir, "part").select(F.col("p_name").alias("cue")).distinct().withColumn("filename", F.concat("cue", F.lit(".mp3")))
    index = cues.where(F.length("cue") % 2 == 0).select("filename", F.concat("cue", F.lit("!")).alias("asset"))
    none = cues.select("cue", F.lit(None).cast("string").alias("asset"), *[F.lit(None).cast("double").alias(c) for c in ("coverage", "jaccard", "score")], F.lit(None).cast("int").alias("rank"), F.lit("NONE").alias("tier"))
    return matching.with_exact(cues, index, none).select("cue", "tier", "asset")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey % 10 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders""")
def field_updates(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return merge.set_fields(rows, F.col("o_custkey") % 10 == 0, {"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(0.0)}).drop("o_custkey")


@query("""WITH f AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('/w/parsed/show', page_id % 5, '/parsed_S01E', lpad(CAST(page_id AS VARCHAR), 2, '0'), '.json') WHEN 1 THEN concat('/w/parsed_E', page_id, '.json') ELSE concat('/w/stems/a/V', page_id, '.txt') END AS path FROM pages)
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('show', page_id % 5) WHEN 2 THEN 'a' END AS show_dir, CASE page_id % 3 WHEN 0 THEN concat('S01E', lpad(CAST(page_id AS VARCHAR), 2, '0')) WHEN 1 THEN concat('E', page_id) END AS tag FROM f""")
def episode_paths(spark, sf_dir):
    number = F.col("page_id").cast("string")
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(F.substring(number, 1, 2))
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/w/parsed/show"), (F.col("page_id") % 5).cast("string"), F.lit("/parsed_S01E"), padded, F.lit(".json")))
    path = path.when(F.col("page_id") % 3 == 1, F.concat(F.lit("/w/parsed_E"), number, F.lit(".json"))).otherwise(F.concat(F.lit("/w/stems/a/V"), number, F.lit(".txt")))
    show, tag = readers.path_parts(path)
    return read(spark, sf_dir, "pages").select("page_id", show.alias("show_dir"), tag.alias("tag"))


# Intake


@query("""WITH m AS (SELECT s_suppkey AS seq, printf('zip/%03d_x.', s_suppkey) || CASE WHEN s_suppkey % 7 = 0 THEN 'txt' ELSE 'MP3' END AS member FROM supplier), e AS (SELECT p_partkey AS seq, CASE p_partkey % 4 WHEN 0 THEN 'dialogue' WHEN 1 THEN 'direction' WHEN 2 THEN 'direction' ELSE 'scene_header' END AS type,
        CASE p_partkey % 4 WHEN 1 THEN 'MUSIC' WHEN 2 THEN 'BEAT' END AS direction_type FROM part WHERE p_partkey % 11 <> 0),
    j AS (SELECT member, m.seq, type, direction_type, CASE WHEN type IS NOT NULL THEN printf('%03d_act1', m.seq) || CASE WHEN type = 'dialogue' THEN '_adam' ELSE '_sfx' END || '.mp3' END AS stem FROM m LEFT JOIN e USING (seq) WHERE NOT suffix(member, 'txt'))
    SELECT member, seq, stem, CASE WHEN type IS NULL THEN 'missing' WHEN type = 'scene_header' THEN 'header' WHEN direction_type = 'BEAT' THEN 'skip' WHEN seq % 5 = 0 THEN 'exists' ELSE 'extract' END AS outcome FROM j""")
def archive_plan(spark, sf_dir):
    ending = F.when(F.col("s_suppkey") % 7 == 0, "txt").otherwise("MP3")
    members = read(spark, sf_dir, "supplier").select(F.concat(F.format_string("zip/%03d_x.", "s_suppkey"), ending).alias("member"))
    turn = F.col("p_partkey") % 4
    kind = F.when(turn == 0, "dialogue").when(turn == 3, "scene_header").otherwise("direction")
    entries = read(spark, sf_dir, "part").where("p_partkey % 11 <> 0").select(
        F.col("p_partkey").cast("long").alias("seq"), kind.alias("type"), F.lit("act1").alias("section"), F.lit("").alias("scene"), F.when(turn == 0, "adam").alias("speaker"), F.when(turn == 1, "MUSIC").when(turn == 2, "BEAT").alias("direction_type")
    )
    present = entries.where("seq % 5 = 0").select(t.stem_name(F.col("seq"), F.col("section"), F.col("scene"), F.col("speaker"), F.col("type")).alias("stem")).select(F.concat("stem", F.lit(".mp3")).alias("stem"))
    return intake.archive_plan(members, entries, present, ["MUSIC"])


@query("""WITH s AS (SELECT DISTINCT p_type AS name FROM part), e AS (SELECT p_partkey AS "at", 'scripts/' || p_type || '/' || p_name AS source FROM part WHERE p_size % 2 = 0) SELECT name, (SELECT min("at") FROM e WHERE contains(source, name)) AS first_at FROM s""")
def script_sources(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    parsed = parts.where("p_size % 2 = 0").select(F.concat(F.lit("scripts/"), "p_type", F.lit("/"), "p_name").alias("source_file"), F.col("p_partkey").alias("at"))
    return intake.script_of_episode(parts.select(F.col("p_type").alias("name")).distinct(), parsed).select("name", F.col("episode.at").alias("first_at"))


@query(f"""WITH h AS (SELECT page_id, {_HEADER} AS line FROM pages) SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN printf('SXXE%02d_latehour_The_%dth_v1.md', page_id, page_id) ELSE printf('S%02dE%02d_latehour_Night_%d_v1.md', page_id % 9, page_id, page_id) END AS file_name FROM h""")
def suggested_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", intake.suggested_name(t.script_header(F.expr(_HEADER))).alias("file_name"))


@query("""SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal > 5000 DESC, lower(c_name), c_custkey) AS place, regexp_matches(c_name, '^[A-Za-z0-9_-]+$') AS safe,
    replace(replace(c_name, '#', '<#>'), '<#>', '&lt;#&gt;') AS shown FROM customer""")
def marked_order(spark, sf_dir):
    """All customers numbered: those with much on their account first, then by name."""
    flag, name = F.coalesce(F.col("c_acctbal") > 5000, F.lit(False)), F.lower(F.coalesce("c_name", F.lit("")))
    rows = sequence.numbered(read(spark, sf_dir, "customer"), [~flag, F.substring(name, 1, 16)], [*intake.marked_first(F.col("c_acctbal") > 5000, "c_name"), "c_custkey"], "place")
    return rows.select("c_custkey", "c_name", "place", intake.is_identifier(F.col("c_name")).alias("safe"), intake.html_text(F.replace("c_name", F.lit("#"), F.lit("<#>"))).alias("shown"))


@query("""SELECT printf('%.3f', l_quantity) || chr(9) || printf('%.3f', l_quantity + l_tax) || chr(9) || l_linestatus AS value FROM lineitem""")
def label_track(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return intake.label_lines(timeline.layer(rows, "cues", F.col("l_quantity"), F.col("l_quantity") + F.col("l_tax"), F.col("l_linestatus")))



# Sound: the order lines of a supplier as the samples of a recording


_SOUND = """sound AS (SELECT 's' || l_suppkey AS path, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS frame, CAST(floor(l_extendedprice) AS BIGINT) % 60000 - 30000 AS sample FROM lineitem)"""


def supplier_sounds(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    sample = F.floor("l_extendedprice").cast("long") % 60000 - 30000
    rows = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("path"), F.lit(8000).cast("long").alias("rate"), (F.row_number().over(order) - 1).cast("long").alias("frame"), sample.alias("sample"))
    return mixing.blocks_of(rows, 256)


@query(f"""WITH {_SOUND}, placed AS (SELECT p_size AS mix, p_partkey AS layer, 's' || p_partkey % 10 AS path, CAST(p_partkey % 700 - 40 AS BIGINT) AS start, CAST(p_partkey % 90 AS BIGINT) AS skip, CAST(p_partkey % 400 + 1 AS BIGINT) AS length, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 120 + 1 AS BIGINT) END AS period,
        CASE WHEN p_partkey % 5 = 0 THEN -6.0 END AS gain FROM part),
    heard AS (SELECT mix, layer, path, start + u.t AS frame, skip + u.t % coalesce(period, length) AS own, gain FROM (SELECT *, unnest(range(length)) AS t FROM placed) u WHERE start + u.t >= 0 AND start + u.t < 700),
    laid AS (SELECT mix, h.frame, list(CASE WHEN gain IS NULL THEN sample ELSE CAST(floor(sample * pow(10.0, gain / 20)) AS BIGINT) END ORDER BY layer) AS samples FROM heard h JOIN sound s ON s.path = h.path AND s.frame = own GROUP BY mix, h.frame)
    SELECT m.mix, m.frame, coalesce(list_reduce(list_prepend(CAST(0 AS BIGINT), samples), lambda a, b: greatest(-32768, least(32767, a + b))), 0) AS sample
    FROM (SELECT DISTINCT p_size AS mix, unnest(range(700)) AS frame FROM part) m LEFT JOIN laid l ON l.mix = m.mix AND l.frame = m.frame""")
def mixdown(spark, sf_dir):
    """One mix for each size of parts: each part places a supplier's recording in it, cut, looped or damped."""
    key, parts = F.col("p_partkey"), read(spark, sf_dir, "part")
    whole = lambda c: c.cast("long")
    placements = parts.select(
        F.col("p_size").alias("mix"), key.alias("layer"), F.concat(F.lit("s"), key % 10).alias("path"), whole(key % 700 - 40).alias("start"), whole(key % 90).alias("skip"), whole(key % 400 + 1).alias("length"),
        F.when(key % 3 == 0, whole(key % 120 + 1)).alias("period"), F.when(key % 5 == 0, -6.0).alias("gain"),
    )
    mixes = parts.select(F.col("p_size").alias("mix"), F.lit(700).cast("long").alias("length")).distinct()
    return mixing.samples_of(mixing.mixdown(mixes, placements, supplier_sounds(spark, sf_dir), 256), "mix", "block", 256)


@query(f"""WITH RECURSIVE {_SOUND}, a AS (SELECT (1 / 8000::DOUBLE) / (1 / (500.0::DOUBLE * 2 * pi()) + 1 / 8000::DOUBLE) AS alpha),
    x AS (SELECT path, frame, sample::DOUBLE AS x FROM sound),
    y AS (SELECT path, frame, x AS last FROM x WHERE frame = 0 UNION ALL SELECT x.path, x.frame, y.last + alpha * (x.x - y.last) FROM y JOIN x ON x.path = y.path AND x.frame = y.frame + 1, a)
    SELECT path, frame, CAST(trunc(last) AS BIGINT) AS sample FROM y""")
def low_pass(spark, sf_dir):
    """Every supplier's recording behind a low pass of 500 hertz."""
    return mixing.samples_of(mixing.one_pole(supplier_sounds(spark, sf_dir), 500.0, "low"), "path", "part", 256)


# Edits and plans of episodes


@query(f"""WITH {TURNS}, e AS (SELECT conv_id, seq, max(quality) AS quality FROM turns JOIN labels ON doc_id = conv_id GROUP BY ALL),
    edited AS (SELECT t.* REPLACE (CASE WHEN type = 'dialogue' AND quality = 1 AND seq % 2 = 0 THEN text || '!' ELSE text END AS text), quality, text AS was FROM turns t LEFT JOIN e USING (conv_id, seq))
    SELECT conv_id, count(*) FILTER (text <> was) AS changed, CAST(coalesce(sum(length(text)) FILTER (type = 'dialogue'), 0) AS BIGINT) AS characters_for_tts, count(*) FILTER (type = 'dialogue') AS dialogue_lines
    FROM edited GROUP BY conv_id HAVING count(*) FILTER (text <> was) > 0""")
def edited_dialogue(spark, sf_dir):
    """Every second turn of well rated conversations with a mark behind it: what that changes in their statistics."""
    entries = turns(spark, sf_dir).withColumn("direction", F.lit(None).cast("string"))
    good = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("conv_id")).distinct()
    edits = entries.join(good, "conv_id", "left_semi").where("seq % 2 = 0").select("conv_id", "seq", F.lit("1").alias("ts"), F.create_map(F.lit("text"), F.concat("text", F.lit("!"))).alias("fields"))
    found = merge.edit_dialogue(entries, edits, ["conv_id"])
    counts = found.journal.groupBy("conv_id").agg(F.count("*").alias("changed"))
    return found.stats.join(counts, "conv_id").select("conv_id", "changed", "characters_for_tts", "dialogue_lines")


@query("""WITH entries AS (SELECT l_suppkey AS tag, l_orderkey AS seq, max(CASE l_returnflag WHEN 'R' THEN 'direction' WHEN 'N' THEN 'dialogue' ELSE 'scene_header' END) AS type, max(CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'AMBIENCE' END END) AS direction_type,
        CASE WHEN l_orderkey % 2 = 0 THEN 'AMBIENCE: STOP' ELSE 'rain' END AS text, 'eve' AS speaker FROM lineitem GROUP BY ALL),
    stems AS (SELECT l_suppkey AS tag, l_orderkey AS seq, l_linenumber || '.mp3' AS path, CASE WHEN l_linenumber % 2 = 0 THEN 'x_sfx' WHEN l_linenumber % 3 = 0 THEN 'x_adam' ELSE 'x_eve' END AS base FROM lineitem WHERE l_discount > 0.02),
    e AS (SELECT tag, seq, max(type) AS type, max(direction_type) AS direction_type, max(text) AS text, max(speaker) AS speaker FROM entries GROUP BY 1, 2),
    m AS (SELECT s.*, type, direction_type, text, CASE WHEN type = 'scene_header' THEN 'seq ' || seq || ' is now a scene_header entry' WHEN base = 'x_sfx' AND type = 'dialogue' THEN 'seq ' || seq || ' is now a dialogue entry'
        WHEN base <> 'x_sfx' AND type = 'direction' THEN 'seq ' || seq || ' is now a direction entry' WHEN type = 'dialogue' AND base <> 'x_eve' THEN 'seq ' || seq || ' speaker is now eve' END AS reason FROM stems s JOIN e USING (tag, seq)),
    d AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND path <> min(path) FILTER (reason IS NULL) OVER (PARTITION BY tag, seq) THEN 'seq ' || seq || ' already loaded' ELSE reason END AS reason) FROM m)
    SELECT tag, seq, path, CASE WHEN reason IS NULL THEN 'stem' ELSE 'rejected' END AS plan, reason FROM d
    UNION ALL SELECT tag, seq, '', 'sentinel', NULL FROM e WHERE direction_type = 'AMBIENCE' AND text = 'AMBIENCE: STOP' AND (tag, seq) NOT IN (SELECT (tag, seq) FROM d WHERE reason IS NULL)""")
def stem_plan(spark, sf_dir):
    """Order lines as stems of their suppliers' episodes: what is used, what is left out and why, and the stops that bound the others."""
    rows = read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "direction").when(F.col("l_returnflag") == "N", "dialogue").otherwise("scene_header")
    ambience = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "AMBIENCE")
    key = [F.col("l_suppkey").alias("tag"), F.col("l_orderkey").alias("seq")]
    entries = rows.groupBy(*key).agg(F.max(kind).alias("type"), F.max(ambience).alias("direction_type")).withColumns(
        {"text": F.when(F.col("seq") % 2 == 0, "AMBIENCE: STOP").otherwise("rain"), "speaker": F.lit("eve"), "section": F.lit("main"), "scene": F.lit(None).cast("string")}
    )
    number = F.col("l_linenumber")
    base = F.when(number % 2 == 0, "x_sfx").when(number % 3 == 0, "x_adam").otherwise("x_eve")
    stems = rows.where("l_discount > 0.02").select(*key, F.concat(number.cast("string"), F.lit(".mp3")).alias("path"), base.alias("base"))
    return joins.stem_plans(stems, entries, ["tag"]).select("tag", "seq", "path", "plan", "reason")
