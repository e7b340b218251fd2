"""Exports: JSON lines, injection-safe CSV, content-named files, notice indexes and whole-registry copies."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid.functions import codes
from noticegrid.functions.text import html_escape
from noticegrid.operators.aggregates import table_counts
from noticegrid.operators.reconcile import same_rows

STATE_LABELS = {
    "pending": "Odottaa keruuta", "fetched": "Tallennettu", "failed": "Lataus epäonnistui",
    "blocked": "Lähteen käyttörajoitus"}
EXTRACTION_LABELS = {
    "extracted": "Teksti poimittu", "partial_text": "Teksti tarkistettava", "unreadable": "Kokoteksti puuttuu",
    "not_extracted": "Tekstiä ei vielä poimittu"}


def write_jsonl(df: DataFrame, path: str, files: int | None = None) -> None:
    (df.coalesce(files) if files else df).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def safe_text_columns(df: DataFrame) -> DataFrame:
    return df.select(*(codes.safe_cell(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes))


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, bom: bool = False) -> None:
    """CSV with header; text cells cannot be read as formulas; other columns than ``fields`` are left out.

    ``bom`` starts each file with a byte-order mark, which spreadsheet programs expect.
    """
    rows = safe_text_columns(df.select(*fields) if fields else df)
    if bom:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    keep_blanks = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows.write.mode("errorifexists").options(header="true", escape='"', emptyValue="", **keep_blanks).csv(path)


def manifest(tables: dict[str, DataFrame], schema_version: str, as_of: str) -> DataFrame:
    """One row: version, as-of, counts per table. Completeness is never claimed."""
    counts = table_counts(tables)
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("table_name", "n"))))  # one entry per table
    return counts.agg(pairs.alias("counts")).select(
        F.lit(schema_version).alias("schema_version"), F.lit(as_of).alias("exported_at_utc"), "counts",
        F.lit(False).alias("completeness_verified"))


def export_registry(view: DataFrame, sources: DataFrame, path: str, schema_version: str, as_of: str) -> DataFrame:
    """Registry as JSON lines and CSV with its sources and manifest."""
    write_jsonl(view, f"{path}/opportunities.jsonl")
    write_csv(view, f"{path}/opportunities.csv", bom=True)
    write_jsonl(sources, f"{path}/sources.json")
    facts = manifest({"opportunities": view, "sources": sources}, schema_version, as_of)
    write_jsonl(facts, f"{path}/manifest.json", files=1)
    return facts


def export_document_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Documents, bridge, links and versions, one folder of JSON lines each."""
    for name, table in tables.items():
        write_jsonl(table, f"{path}/{name}.jsonl")


def content_files(blobs: DataFrame) -> DataFrame:
    """Names of the original and text file of each content, which must still match its hash."""
    intact = F.sha2("original", 256) == F.col("sha256")
    name = F.concat(F.lit("originals/"), F.col("sha256"), codes.extension(F.col("media_type")))
    checked = F.when(intact, name).otherwise(F.raise_error(F.concat(
        F.lit("Document checksum mismatch during export: "), F.col("sha256"))))
    return blobs.withColumn("original_file", checked).withColumn(
        "text_file", F.concat(F.lit("texts/"), F.col("sha256"), F.lit(".txt")))


def write_contents(blobs: DataFrame, path: str) -> DataFrame:
    """Write each content under its hash in a folder all executors share; returns the index.

    A retried task rewrites the same names with the same bytes.
    """
    named = content_files(blobs)

    def write(rows):
        store, root = _store(path)
        for sub in ("originals", "texts"):
            store.create_dir(f"{root}/{sub}")
        for row in rows:
            _put(store, f"{root}/{row.original_file}", bytes(row.original))
            _put(store, f"{root}/{row.text_file}", row.text.encode("utf-8"))

    named.select("original", "text", "original_file", "text_file").foreachPartition(write)
    index = named.drop("original", "text")
    write_jsonl(index, f"{path}/contents.jsonl")
    return index


def _store(path: str):
    """(file system, root) of a folder that every executor reaches: a mounted path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(store, name: str, data: bytes) -> None:
    """Write beside the target and move into place, so a lost task leaves no half file under the name."""
    import uuid

    part = f"{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as stream:
        stream.write(data)
    store.move(part, name)


def issue_text(error: Column, limitation: Column) -> Column:
    """Reader-facing words for a document's error or limitation."""
    issue = F.coalesce(error, limitation)
    parts = F.split(issue, r"\|", 3)
    return (
        F.when(issue == codes.fixed.DOWNLOAD_RETURNED_HTML,
               "Asiakirjalinkki palautti verkkosivun. Varsinaista liitetiedostoa ei saatu.")
        .when(issue == codes.fixed.REDIRECTED_TO_FRONT,
              "Lisätietolinkki ohjasi etusivulle. Pyydettyä ohjetta tai sisältösivua ei saatu.")
        .when(issue.startswith("RATE_LIMIT|"), F.concat(
            F.lit("Lähde rajoittaa pyyntöjä ("), F.get(parts, 1), F.lit("). Keruu voi jatkua aikaisintaan "),
            F.get(parts, 2), F.lit(" UTC.")))
        .otherwise(issue))


def index_fragments(export: DataFrame) -> DataFrame:
    """One escaped HTML fragment per (notice, document), with its place in the notice's index."""
    url = html_escape(F.col("url"))
    state = F.coalesce(codes.lookup(F.col("state"), STATE_LABELS), F.col("state"))
    text = codes.lookup(F.coalesce("extraction_status", F.lit("")), EXTRACTION_LABELS, EXTRACTION_LABELS["not_extracted"])
    issue = issue_text(F.col("error"), F.col("limitation"))
    note = F.when(issue.isNotNull(), F.concat(F.lit('<p class="note">Puute: '), html_escape(issue), F.lit("</p>"))).otherwise("")
    link = F.when(F.col("current_sha256").isNotNull(), F.concat(
        F.lit('<p class="actions"><a href="../texts/'), F.col("current_sha256"), F.lit('.txt">Lue koko teksti</a></p>'))).otherwise("")
    article = F.concat(
        F.lit("<article><h2>"), url, F.lit("</h2><p>"), state, F.lit(" · "), text, F.lit("</p>"),
        F.lit('<p class="meta">Lähde: <a rel="noreferrer noopener" href="'), url, F.lit('">'), url, F.lit("</a></p>"), link, note, F.lit("</article>"))
    empty = F.lit('<p class="note">Asiakirjojen keruuta ei ole vielä aloitettu.</p>')
    return export.select(
        "opportunity_id", "title", "document_id", "depth", "url",
        F.when(F.col("document_id").isNull(), empty).otherwise(article).alias("fragment"))


HEAD = '<!doctype html><html lang="fi"><head><meta charset="utf-8"><title>{0}</title></head><body><main><h1>{0}</h1>'
FOOT = "</main></body></html>"


def write_indexes(fragments: DataFrame, path: str, partitions: int | None = None) -> None:
    """One HTML file per notice in a shared folder.

    Rows are range-sorted by (notice, depth, address) and streamed to the open file, so a notice
    with any number of documents is never held in memory. A notice that spans two ranges is written
    in numbered parts, joined by name order.
    """
    parts = partitions or max(1, int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["opportunity_id", F.coalesce("depth", F.lit(-1)), F.coalesce("url", F.lit(""))]
    rows = fragments.withColumn("heading", html_escape(F.col("title"))).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def write(index, it):
        store, root = _store(path)
        store.create_dir(root)
        current, stream, target = None, None, None

        def close():
            if stream:
                stream.write(FOOT.encode("utf-8"))
                stream.close()
                store.move(target + ".part", target)

        for row in it:
            if row.opportunity_id != current:
                close()
                current = row.opportunity_id
                target = f"{root}/{current}.{index:05d}.html"
                stream = store.open_output_stream(target + ".part")
                stream.write(HEAD.format(row.heading).encode("utf-8"))
            stream.write(row.fragment.encode("utf-8"))
        close()
        return iter(())

    rows.select("opportunity_id", "heading", "fragment").rdd.mapPartitionsWithIndex(write).count()


def transfer(tables: dict[str, DataFrame], target: str, source_version: str, target_version: str) -> dict[str, bool]:
    """Copy all tables to an empty target of the same schema version and compare every one."""
    if source_version != target_version:
        raise ValueError("Database schema versions differ")
    spark: SparkSession = next(iter(tables.values())).sparkSession
    for name in tables:
        if _exists(spark, f"{target}/{name}"):
            raise ValueError(f"Destination table is not empty: {name}")
    checks = {}
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{target}/{name}")
        checks[name] = same_rows(table, spark.read.schema(table.schema).parquet(f"{target}/{name}"))
    return checks


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def delivery_metrics(sections: list[DataFrame], as_of: str) -> DataFrame:
    """One row ``metrics_json``: every section an object of counts; a section with the key ``all`` alone is one number."""
    rows = reduce(lambda a, b: a.unionByName(b), sections)
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n"))))  # keys of one section: sources, states, formats
    by_section = rows.groupBy("section").agg(F.to_json(pairs).alias("many"), F.max("n").alias("one"), (F.min("key") == "all").alias("single"))
    body = F.when(F.col("single"), F.col("one").cast("string")).otherwise(F.col("many"))
    line = F.concat(F.lit('"'), F.col("section"), F.lit('":'), body)
    head = F.lit('{"as_of_utc":' + json.dumps(as_of) + ",")
    return by_section.agg(F.concat(head, F.array_join(F.array_sort(F.collect_list(line)), ","), F.lit("}")).alias("metrics_json"))
