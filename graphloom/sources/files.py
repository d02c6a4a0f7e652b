"""Readers and writers; rows that lack what is required are left out or handed back apart, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import strip_html

NODE, EDGE = ["id", "label", "file_type", "source_file"], ["source", "target", "relation", "confidence", "source_file"]


def _core(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows(r: map) -> the required fields with the rest as extras, and the rows that lack one (blank counts as lacking)."""
    whole = F.lit(True)
    for c in required:
        whole = whole & (F.coalesce(F.col("r")[c], F.lit("")) != "")
    extras = F.map_filter("r", lambda k, _: ~k.isin(required)).alias("extras")
    return rows.filter(whole).select(*[F.col("r")[c].alias(c) for c in required], extras), rows.filter(~whole)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A node-link JSON file -> nodes, edges (links, else edges) with extras as a map, and rejected rows with their kind."""
    one = "array<map<string,string>>"
    g = spark.read.schema(f"nodes {one}, links {one}, edges {one}").json(path, multiLine=True)
    nodes, bad_nodes = _core(g.select(F.explode("nodes").alias("r")), NODE)
    edges, bad_edges = _core(g.select(F.explode(F.coalesce("links", "edges")).alias("r")), EDGE)
    return nodes, edges, bad_nodes.select(F.lit("node").alias("kind"), "r").unionByName(bad_edges.select(F.lit("edge").alias("kind"), "r"))


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.parquet(f"{folder}/nodes")
    edges.write.parquet(f"{folder}/edges")


def _when(text: Column) -> Column:
    """A feed's date: ISO or the mail form; null where it cannot be read."""
    mail = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS items and Atom entries -> source_uri, title, text, published_at, author, enclosure_url, enclosure_type, duration.

    An RSS item needs a link; an entry takes its alternate link, else the first. Text is the content, else the summary, without tags.
    """
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED").schema(schema).load(path)
    rss = xml("item", "title string, link string, description string, `content:encoded` string, pubDate string, author string, `dc:creator` string, enclosure struct<_url:string,_type:string>, `itunes:duration` string")
    rss = rss.select(F.trim("link").alias("source_uri"), "title", F.coalesce("content:encoded", "description").alias("text"), _when(F.col("pubDate")).alias("published_at"), F.coalesce("author", "dc:creator").alias("author"), F.col("enclosure._url").alias("enclosure_url"), F.col("enclosure._type").alias("enclosure_type"), F.col("itunes:duration").alias("duration"))
    atom = xml("entry", "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, updated string, published string, author struct<name:string>")
    links = F.coalesce("link", F.array().cast("array<struct<_href:string,_rel:string>>"))
    href = F.coalesce(F.get(F.filter(links, lambda x: x["_rel"] == "alternate"), 0)["_href"], F.get(F.filter(links, lambda x: x["_href"].isNotNull()), 0)["_href"])
    none = F.lit(None).cast("string")
    atom = atom.select(href.alias("source_uri"), "title", F.coalesce("content", "summary").alias("text"), _when(F.coalesce("published", "updated")).alias("published_at"), F.col("author.name").alias("author"), none.alias("enclosure_url"), none.alias("enclosure_type"), none.alias("duration"))
    both = rss.unionByName(atom).filter(F.coalesce("source_uri", F.lit("")) != "")
    return both.withColumn("title", strip_html(F.col("title"))).withColumn("text", strip_html(F.coalesce("text", F.lit(""))))


def arxiv_items(items: DataFrame) -> DataFrame:
    """Feed items with the version cut off their address."""
    return items.withColumn("source_uri", F.regexp_replace("source_uri", r"v\d+$", ""))


def git_log(spark: SparkSession, path: str, separator: str = "\x1e") -> DataFrame:
    """A log of blocks hash, author, date, subject, body -> source_uri, title, text, author, published_at; shorter blocks are left out."""
    block = F.regexp_replace("value", r"^\s+|\s+$", "")
    b = spark.read.text(path, lineSep=separator).select(F.split(block, "\n").alias("l")).filter(F.size("l") >= 4)
    text = F.array_join(F.slice("l", 4, 1_000_000), "\n")
    return b.select(F.concat(F.lit("git://"), F.get("l", 0)).alias("source_uri"), F.get("l", 3).alias("title"), text.alias("text"), F.get("l", 1).alias("author"), _when(F.get("l", 2)).alias("published_at"))


def package_items(spark: SparkSession, path: str, dev: bool = True) -> DataFrame:
    """A package manifest -> name, version, one row for each package it depends on."""
    m = spark.read.schema("dependencies map<string,string>, devDependencies map<string,string>").json(path, multiLine=True)
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce("dependencies", empty)
    more = F.map_filter(F.coalesce("devDependencies", empty), lambda k, _: ~F.map_contains_key(own, k)) if dev else empty
    return m.select(F.explode(F.map_concat(own, more)).alias("name", "version"))


def code_files(spark: SparkSession, path: str) -> DataFrame:
    """Source files -> path, exports, imported paths, number of lines, the first lines of the first doc block."""
    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    doc = F.array_join(F.slice(F.split(F.regexp_replace(F.regexp_replace(F.regexp_extract("text", r"(?s)/\*\*(.*?)\*/", 1), r"(?m)^[ \t]*\*[ \t]?", ""), r"^\s+|\s+$", ""), "\n"), 1, 5), "\n")
    exports = F.regexp_extract_all("text", F.lit(r"export\s+(?:default\s+)?(?:async\s+)?(?:const|let|function|class|interface|type|enum)\s+([A-Za-z_$][\w$]*)"), F.lit(1))
    imports = F.regexp_extract_all("text", F.lit(r"import\s[^;]*?from\s+['\"]([^'\"]+)['\"]"), F.lit(1))
    return f.select("path", exports.alias("exports"), imports.alias("imports"), F.size(F.split("text", "\n")).alias("n_lines"), F.when(F.length(doc) > 10, doc).alias("doc"))


def read_beir(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus(doc_id, text), queries with judgments (query_id, text), qrels(query_id, doc_id) with a score over 0."""
    c = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    rel = spark.read.option("sep", "\t").option("header", True).schema("query_id string, doc_id string, score int").csv(f"{folder}/qrels.tsv").filter("score > 0").select("query_id", "doc_id")
    q = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), "text").join(rel, "query_id", "left_semi")
    return c.select(F.col("_id").alias("doc_id"), F.concat_ws(". ", "title", "text").alias("text")), q, rel


def read_jsonl(spark: SparkSession, path: str, schema: str, last: int | None = None, order: str | None = None) -> DataFrame:
    """Lines of JSON; lines that cannot be read are skipped; of receipts, the last few."""
    df = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return df if last is None else df.orderBy(F.desc(order)).limit(last)


def export_bundle(spark: SparkSession, paths: list[str], out: str) -> None:
    """Daily logs, plain or gzipped, merged in order of their text and written gzipped."""
    spark.read.text(paths).filter("trim(value) <> ''").orderBy("value").write.option("compression", "gzip").text(out)


def prune_backup(rows: DataFrame, gone: DataFrame, out: str) -> None:
    """What a deletion will remove, as lines of JSON."""
    rows.join(gone.select("id").distinct(), "id", "left_semi").write.json(out)


def file_size_filter(files: DataFrame, most: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """files(path, text) -> those with an absolute path, some text and not too much of it; how many were left out and why."""
    why = F.when(~F.startswith("path", F.lit("/")), "relative").when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty").when(F.length("text") > most, "too_long")
    x = files.withColumn("why", why)
    return x.filter("why is null").drop("why"), x.filter("why is not null").groupBy("why").agg(F.count("*").alias("n"))


_BLOCK = "array<struct<type:string,text:string,name:string,input:struct<file_path:string,path:string,pattern:string,command:string>>>"
_LINE = "type string, uuid string, parentUuid string, sessionId string, timestamp string, cwd string, gitBranch string, message struct<content:string>, attachment struct<type:string,hookEvent:string,content:string>"


def session_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript lines -> kind, uuid, session, at, cwd, branch, summary, tool_calls; lines that cannot be read or lack their names are left out.

    content is a string or a list of blocks: the string is read, and tried as blocks.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(folder).select(F.from_json("value", _LINE).alias("e")).select("e.*")
    raw = raw.filter("uuid is not null and sessionId is not null and timestamp is not null")
    blocks = F.from_json("message.content", _BLOCK)
    said = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = F.coalesce(F.when(F.startswith(F.trim("message.content"), F.lit("[")), said), "message.content")
    call = lambda b: F.struct(b["name"].alias("tool"), F.coalesce(b["input"]["file_path"], b["input"]["path"], b["input"]["pattern"]).alias("target_path"), F.substring(b["input"]["command"], 1, 200).alias("command"))
    calls = F.transform(F.filter(F.coalesce(blocks, F.array().cast(_BLOCK)), lambda b: b["type"] == "tool_use"), call)
    kind = F.when(F.col("type").isin("user", "assistant"), F.col("type")).when((F.col("type") == "attachment") & (F.col("attachment.hookEvent") == "SessionStart"), "session_start_hook")
    out = raw.select(kind.alias("kind"), "uuid", F.col("sessionId").alias("session"), F.try_to_timestamp("timestamp").alias("at"), "cwd", F.col("gitBranch").alias("branch"), F.substring(F.coalesce(text, "attachment.content", F.lit("")), 1, 200).alias("summary"), calls.alias("tool_calls"))
    return out.filter("kind is not null")


def rollout_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Rollout files -> uuid, session, kind, cwd, text: a session_meta line names the session of the lines after it."""
    f = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    e = f.select("file", "line", F.from_json("value", "type string, payload struct<id:string,cwd:string,type:string,role:string,content:array<struct<text:string>>>").alias("e"))
    meta = F.when(F.col("e.type") == "session_meta", F.struct(F.col("e.payload.id").alias("id"), F.col("e.payload.cwd").alias("cwd")))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = e.withColumn("meta", F.last(meta, ignorenulls=True).over(w)).withColumn("text", F.array_join(F.col("e.payload.content.text"), "\n"))
    x = x.filter((F.col("e.type") == "response_item") & (F.col("e.payload.type") == "message") & F.col("e.payload.role").isin("user", "assistant") & (F.trim("text") != "") & F.col("meta").isNotNull())
    return x.select(F.concat_ws("#", "meta.id", F.col("line").cast("string")).alias("uuid"), F.col("meta.id").alias("session"), F.col("e.payload.role").alias("kind"), F.col("meta.cwd").alias("cwd"), "text")
