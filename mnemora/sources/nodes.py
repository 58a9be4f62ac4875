"""Node files: markdown with a typed header between `---` fences. Reading, parsing, header edits and writing as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.text import typed_scalar

#: Header keys that become typed columns; all others stay in the map `header`.
TYPED = {
    "name": "string", "description": "string", "type": "string", "tier": "string", "material_grade": "string", "runtime": "string", "target_state": "string",
    "valid_from": "date", "valid_to": "date", "last_access": "date", "next_review": "date", "access_count": "bigint", "episode_seq": "bigint",
    "review_count": "bigint", "review_interval_days": "bigint", "relevance": "double", "salience": "double", "integrity": "double", "written_at": "double",
    "stc_capture_score": "double", "stc_capture_at": "double", "easiness_factor": "double",
}
_FENCED = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n(.*))?$"


def read_node_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path: `id` (file name without ending), `text`, `modified_at`."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return raw.select(F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), r"\.md$", "").alias("id"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified_at"))


def header_lines(text: str | Column) -> Column:
    """Lines of the header in order; null without a header."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.rlike(_FENCED), F.filter(F.split(F.regexp_extract(c, _FENCED, 1), r"\r?\n"), lambda x: F.trim(x) != ""))


def header_get(lines: str | Column, key: str) -> Column:
    """Value of the first line of a key; null when absent."""
    c = F.col(lines) if isinstance(lines, str) else lines
    hit = F.filter(c, lambda x: F.startswith(x, F.lit(f"{key}:")))
    return F.trim(F.substring(F.get(hit, F.lit(0)), len(key) + 2, 1_000_000))


def header_set(lines: str | Column, key: str, value: Column) -> Column:
    """All lines of a key replaced, or the key appended."""
    c = F.col(lines) if isinstance(lines, str) else lines
    line = F.concat(F.lit(f"{key}: "), value.cast("string"))
    has = F.exists(c, lambda x: F.startswith(x, F.lit(f"{key}:")))
    return F.when(has, F.transform(c, lambda x: F.when(F.startswith(x, F.lit(f"{key}:")), line).otherwise(x))).otherwise(F.array_append(c, line))


def parse_nodes(files: DataFrame, text: str = "text") -> DataFrame:
    """Adds typed columns, `chains`, `header` (map of all keys to raw values, first one wins), `key_order` and `body`.

    Texts without a header keep a null header and are the body as they are. A typed column is null where the value does
    not read as its type; dates are their first ten characters.
    """
    lines = header_lines(text)
    split = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    out = files.withColumn("_kv", split).withColumn("key_order", F.array_distinct(F.transform("_kv", lambda e: e["key"])))
    first = F.transform("key_order", lambda k: F.struct(k.alias("k"), F.get(F.filter("_kv", lambda e: e["key"] == k), F.lit(0))["value"].alias("v")))
    out = out.withColumn("header", F.map_from_entries(first)).withColumn("body", F.when(F.col("header").isNull(), F.col(text)).otherwise(F.coalesce(F.regexp_extract(F.col(text), _FENCED, 2), F.lit(""))))
    none = lambda v: F.when(F.lower(v).isin("null", "none", "~", ""), None).otherwise(v)
    for key, kind in TYPED.items():
        raw = none(F.col("header")[key])
        typed = F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd")).cast("date") if kind == "date" else raw if kind == "string" else raw.try_cast(kind)
        out = out.withColumn(key, typed)
    return out.withColumn("chains", typed_scalar(F.col("header")["chains"])["list"]).drop("_kv")


def render_nodes(nodes: DataFrame) -> DataFrame:
    """`id` and `text`: header in `key_order` (each key once), then the other keys of `header` sorted, then the body."""
    rest = F.array_sort(F.array_except(F.map_keys("header"), F.coalesce("key_order", F.expr("cast(array() as array<string>)"))))
    keys = F.concat(F.filter(F.array_distinct(F.coalesce("key_order", F.expr("cast(array() as array<string>)"))), lambda k: F.map_contains_key("header", k)), rest)
    lines = F.transform(keys, lambda k: F.concat(k, F.lit(": "), F.element_at("header", k)))
    text = F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+$", ""), F.lit("\n"))
    return nodes.select("id", F.when(F.col("header").isNull(), F.coalesce("body", F.lit(""))).otherwise(text).alias("text"))


def embedding_text(title: str | Column, description: str | Column, body: str | Column) -> Column:
    """The text that stands for a node in an index: `title. description`, a blank line, the body."""
    t, d, b = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (title, description, body))
    return F.concat(t, F.lit(". "), d, F.lit("\n\n"), b)


def read_chain_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chain manifests (JSON, one object a file): members (`chain`, `pos`, `addr`, `node`) and edges (`chain`, `pos`, `src`, `dst`, dates, `label`, `confidence`)."""
    schema = "chain_id string, members array<struct<addr: string, file: string>>, edges array<struct<`from`: string, `to`: string, valid_from: string, valid_to: string, label: string, confidence: double>>"
    raw = spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter="*.json")
    named = raw.withColumn("chain", F.coalesce("chain_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)))
    members = named.select("chain", F.posexplode("members").alias("pos", "m")).select("chain", "pos", "m.addr", F.regexp_replace(F.regexp_extract("m.file", r"([^/]+)$", 1), r"\.md$", "").alias("node"))
    e = named.select("chain", F.posexplode("edges").alias("pos", "e"))
    day = lambda c: F.try_to_timestamp(F.substring(F.col(c), 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    edges = e.select("chain", "pos", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), day("e.valid_from").alias("valid_from"), day("e.valid_to").alias("valid_to"), "e.label", "e.confidence")
    return members, edges


def chain_manifests(members: DataFrame, edges: DataFrame) -> DataFrame:
    """One manifest row per chain (`chain_id`, `members`, `edges`), as read_chain_files takes them."""
    m = members.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("pos", "addr", F.concat(F.lit("nodes/"), "node", F.lit(".md")).alias("file")))).alias("m"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    e = edges.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("src").alias("from"), F.col("dst").alias("to"), day("valid_from"), day("valid_to"), "label", "confidence"))).alias("e"))
    strip = lambda c, names: F.transform(c, lambda x: F.struct(*(x[n].alias(n) for n in names)))
    both = m.join(e, "chain", "full")
    return both.select(F.col("chain").alias("chain_id"), strip("m", ("addr", "file")).alias("members"), strip("e", ("from", "to", "valid_from", "valid_to", "label", "confidence")).alias("edges"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines log; lines that do not parse are left out."""
    raw = spark.read.text(path)
    parsed = raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    return parsed.where(F.col("r").isNotNull() & F.try_parse_json("value").isNotNull()).select("r.*")


def stream_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """The same log as a stream of its files; progress is the stream's checkpoint."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return raw.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def write_rotating(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Append a log as JSON lines in files of bounded length."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)
