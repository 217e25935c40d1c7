"""Loaders of the two record types, normalisers of raw question rows, shards, caches and manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DECISIONS, letter_key, strip
from ..operators.select import ranked
from ..session import ship
from .registry import LOADERS

QA_SCHEMA = (
    "uid string, source string, split string, question string, options map<string,string>, answer_key string, answer_text string, "
    "contexts array<string>, rationale string, labels map<string,string>, pos long"
)
DOC_SCHEMA = "uid string, source string, text string, title string, meta map<string,string>, pos long"
SHARDS, SHARD_NAME, VERSION = 1166, "chunk/pubmed23n{:04d}.jsonl", 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@LOADERS.register("documents")
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text records of ``documents``, with the id and language beside the record's own fields."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("uid"), F.lit("documents").alias("source"), "text", F.lit("").alias("title"),
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("meta"), F.col("doc_id").alias("pos"), "lang", "doc_id",
    )


@LOADERS.register("pages")
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text records of ``pages``: the title and the text without tags."""
    d = table(spark, sf_dir, "pages")
    body = F.trim(F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", " "), r"\s+", " "))
    return d.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("uid"), F.lit("pages").alias("source"), body.alias("text"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.create_map(F.lit("url"), "url").alias("meta"), F.col("page_id").alias("pos"))


@LOADERS.register("parts")
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice records of ``part``: which brand a part has, with three other brands; a tenth is unlabelled."""
    p = table(spark, sf_dir, "part")
    brands = p.agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))  # one row
    own = F.array_position("brands", F.col("p_brand")) - 1
    gold = (F.col("p_partkey") % 4).cast("int")
    option = lambda j: F.get("brands", ((own + (j - gold + 4) % 4 * 5) % F.size("brands")).cast("int"))
    key = F.when(F.col("p_size") % 10 != 0, letter_key(gold))
    return p.crossJoin(F.broadcast(brands)).select(
        F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")).alias("uid"), F.lit("parts").alias("source"), F.lit("train").alias("split"), F.col("p_name").alias("question"),
        F.create_map(*[x for j, k in enumerate("ABCD") for x in (F.lit(k), option(j))]).alias("options"), key.alias("answer_key"),
        F.when(key.isNotNull(), F.col("p_brand")).alias("answer_text"), F.array(F.col("p_type")).alias("contexts"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("rationale"),
        F.create_map(F.lit("subject"), F.col("p_type")).alias("labels"), F.col("p_partkey").cast("long").alias("pos"),
    )


@LOADERS.register("conversations")
def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows at once."""
    c = table(spark, sf_dir, "conversations")
    a, b = c.where("role = 'user'"), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("question"), F.col("answer").alias("answer_text"))


def _labels(**items: Column) -> Column:
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in items.items()]), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.map_from_entries(entries)


def _numbered(raw: DataFrame, source: str, split: str) -> DataFrame:
    return raw.withColumn("uid", F.format_string("%s/%s/%06d", F.lit(source), F.lit(split), F.col("pos"))).withColumn("_s", F.lit(source)).withColumn("_p", F.lit(split))


def _record(raw: DataFrame, question: Column, options: Column, key: Column, contexts: Column, rationale: Column, labels: Column) -> DataFrame:
    return raw.select(
        "uid", F.col("_s").alias("source"), F.col("_p").alias("split"), question.alias("question"), options.alias("options"), key.alias("answer_key"),
        F.when(key.isNotNull(), F.element_at(options, key)).alias("answer_text"), contexts.alias("contexts"), rationale.alias("rationale"), labels.alias("labels"), "pos",
    )


_NO_CONTEXT = "array<string>"


def normalize_flat_choice(raw: DataFrame, split: str = "train", source: str = "medmcqa") -> DataFrame:
    """Rows with opa..opd, a 0-based answer ``cop`` (other values: unlabelled), explanation and subject; ``pos`` numbers them."""
    raw = _numbered(raw, source, split)
    options = F.create_map(*[x for k, c in zip("ABCD", ("opa", "opb", "opc", "opd"), strict=True) for x in (F.lit(k), F.coalesce(F.col(c), F.lit("")))])
    key = F.when(F.col("cop").between(0, 3), letter_key(F.col("cop")))
    labels = _labels(source_id=F.col("id"), subject=F.col("subject_name"), topic=F.col("topic_name"), choice_type=F.col("choice_type"))
    return _record(raw, F.col("question"), options, key, F.array().cast(_NO_CONTEXT), F.when(F.trim("exp") != "", F.col("exp")), labels)


def normalize_nested_choice(raw: DataFrame, split: str = "train", source: str = "medqa") -> DataFrame:
    """Rows with a struct ``data`` of Question, Options map, Correct Option."""
    raw = _numbered(raw, source, split)
    options, key = F.col("data.Options"), F.col("data.`Correct Option`")
    key = F.when(F.map_contains_key(options, F.coalesce(key, F.lit(""))), key)
    return _record(raw, F.col("data.Question"), options, key, F.array().cast(_NO_CONTEXT), F.lit(None).cast("string"), _labels(source_id=F.col("id"), subject=F.col("subject_name")))


def normalize_decision(raw: DataFrame, config: str, split: str = "train", source: str = "pubmedqa") -> DataFrame:
    """Rows with contexts and a yes/no/maybe decision, which may be absent."""
    raw = _numbered(raw, source, split)
    decision = F.lower(strip(F.col("final_decision"))) if "final_decision" in raw.columns else F.lit(None).cast("string")
    key = F.coalesce(*[F.when(decision == v, k) for k, v in DECISIONS.items()])
    options = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])
    labels = _labels(config=F.lit(config), source_id=F.col("pubid").cast("string"), meshes=F.array_join("context.meshes", "; "), sections=F.array_join("context.labels", "; "))
    return _record(raw, F.col("question"), options, key, F.coalesce("context.contexts", F.array().cast(_NO_CONTEXT)), F.when(F.trim("long_answer") != "", F.col("long_answer")), labels)


def normalize_article(raw: DataFrame) -> DataFrame:
    """Rows of id, title, content, PMID: text records named by the first of id, PMID and position that is set."""
    name = F.coalesce(F.when(F.col("id") != "", F.col("id")), F.when(F.col("PMID") != 0, F.col("PMID").cast("string")), F.col("pos").cast("string"))
    return raw.select(F.concat(F.lit("pubmed/"), name).alias("uid"), F.lit("pubmed").alias("source"), strip(F.col("content")).alias("text"), F.coalesce(strip(F.col("title")), F.lit("")).alias("title"), F.create_map(F.lit("PMID"), F.col("PMID").cast("string")).alias("meta"), "pos")


def invalid(records: DataFrame) -> DataFrame:
    """Records that break the rules of their type, with the first broken rule."""
    need = [c for c in ("uid", "source", "split", "question", "text") if c in records.columns]
    broken = [F.when(strip(F.coalesce(F.col(c), F.lit(""))) == "", f"{c} is blank") for c in need]
    if "options" in records.columns:
        broken += [F.when(F.size("options") == 0, "options are empty"), F.when(F.col("answer_key").isNotNull() & ~F.coalesce(F.map_contains_key("options", F.col("answer_key")), F.lit(False)), "answer_key is not an option")]
    return records.withColumn("problem", F.coalesce(*broken)).where("problem is not null")


def shard_names(count: int, offset: int = 0) -> list[str]:
    """Names of ``count`` shards after ``offset``, up to the last one there is."""
    if offset < 0 or count < 1 or offset >= SHARDS:
        raise ValueError(f"shards {offset + 1} to {offset + count} are not within 1 to {SHARDS}")
    return [SHARD_NAME.format(i) for i in range(offset + 1, min(offset + count, SHARDS) + 1)]


def read_shards(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Rows of JSON-lines shards in file and line order; the first missing file is named."""
    fs = spark._jvm.org.apache.hadoop.fs
    for n in names:
        path = fs.Path(f"{root}/{n}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            raise FileNotFoundError(f"{root}/{n}")
    kind = "id string, title string, content string, PMID long"
    lines = spark.read.text([f"{root}/{n}" for n in names]).where(F.trim("value") != "")
    file = F.array_position(F.array(*map(F.lit, names)), F.substring_index("_metadata.file_path", "/", -2 if "/" in names[0] else -1))
    lines = lines.select(file.alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), F.from_json("value", kind).alias("row"))
    return ranked(lines, F.asc("_file"), F.asc("_block"), F.asc("_line")).select("row.*", (F.col("rank") - 1).alias("pos"))


def cache_key(name: str, config: str, **identity) -> str:
    """What a cached table must agree in: loader, configuration, version and all parameters that shape its rows."""
    return "-".join([name, config, f"v{VERSION}", *(f"{k}={identity[k]}" for k in sorted(identity))])


def write_cache(df: DataFrame, root: str, source: str, split: str, key: str) -> str:
    """A zstd table and its manifest beside it, replaced as a whole."""
    path = f"{root}/{source}/{split}.parquet"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    body = json.dumps({"cache_key": key, "schema_hash": _schema_hash(df.sparkSession.read.parquet(path)), "record_type": "qa" if "options" in df.columns else "doc"})
    df.sparkSession.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{source}/{split}.manifest")
    return path


def read_manifest(spark: SparkSession, root: str, source: str, split: str) -> dict | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{source}/{split}.manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return json.loads(spark.read.text(path.toString()).first().value)


def _schema_hash(df: DataFrame) -> str:
    return hashlib.sha256(df.schema.json().encode()).hexdigest()[:16]


def cache_is_valid(spark: SparkSession, root: str, source: str, split: str, key: str, record_type: str | None = None) -> bool:
    """Whether the table is there, of this loader key and, if given, record type, with the columns its manifest was written for."""
    found = read_manifest(spark, root, source, split)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{source}/{split}.parquet")
    if not found or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return False
    return found["cache_key"] == key and record_type in (None, found["record_type"]) and found["schema_hash"] == _schema_hash(spark.read.parquet(path.toString()))


def read_cache(spark: SparkSession, root: str, source: str, split: str, limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root}/{source}/{split}.parquet")
    return df if limit is None else df.orderBy("pos").limit(limit)


def clear_cache(spark: SparkSession, root: str, source: str | None = None) -> int:
    """How many cached tables went."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{source}" if source else root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{source or '*'}/*.manifest"))
    fs.delete(path, True)
    return len(found or [])


def write_selection(selected: DataFrame, path: str, **facts) -> None:
    """A manifest of the chosen uids, best first, as one JSON file."""
    uids = selected.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "uid"))), lambda x: x["uid"]).alias("selected_uids"))
    uids.select(*[F.lit(v).alias(k) for k, v in facts.items()], "selected_uids").coalesce(1).write.mode("overwrite").json(path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """(uid, rank) of a manifest, with its source and split where it names them; one without uids is refused."""
    df = spark.read.json(path)
    if "selected_uids" not in df.columns:
        raise ValueError(f"{path} has no selected_uids")
    return df.select(F.posexplode("selected_uids").alias("rank", "uid"), *[c for c in ("source", "split") if c in df.columns])
