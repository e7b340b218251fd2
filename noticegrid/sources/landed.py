"""Readers of landed response files. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid.functions.codes import listed_values
from noticegrid.session import materialise

LANGS = "struct<fi:string,sv:string,en:string>"
LISTING = (
    "pageNo int, totalCount int, pageCount int, hakuilmoitukset array<struct<hakuasianAsianumero:string,"
    f"nimi:{LANGS},kuvaus:{LANGS},hakuAlkaaDateTimeUtc:string,hakuPaattyyDateTimeUtc:string,hakuTyyppi:string,"
    f"vastuullinenJarjestajaOrganisaatio:struct<nimi:{LANGS}>>>"
)
EMBEDDED_ROW = (
    "struct<id:string,tila:string,hakuaika:struct<alku:string,loppu:string>,otsikko:string,kuvaus:string,"
    "rahasto:string,viranomainen:string,alue:string,maakunnat:array<string>,jatkuvaHaku:boolean,kokonaistuki:string>"
)
CODE = "map<string,struct<fi:string,sv:string,en:string>>"
EMBEDDED = f"struct<preRenderData:struct<hankehaku:array<{EMBEDDED_ROW}>,koodisto:struct<maakunta:{CODE},viranomainen:{CODE}>>>"
SEARCH_DOCUMENT = (
    "reference string, url string, content string, summary string, metadata map<string,array<string>>"
)
POST = (
    "id bigint, type string, status string, link string, modified_gmt string, title struct<rendered:string>, "
    "content struct<rendered:string>, status_ids array<int>"
)
# As landed: a metadata value is a list or a plain string, kept as JSON text until ``read_search``.
SEARCH_LINE = SEARCH_DOCUMENT.replace("map<string,array<string>>", "map<string,string>") + ", _corrupt string"
FAQ_PAGE = (
    "page_no int, checked_at timestamp_ntz, totalResults int, "
    "results array<struct<reference:string,url:string,metadata:map<string,array<string>>>>"
)
RECORD_LINE = (
    "external_id string, canonical_url string, title string, description string, funder string, programme string, "
    "record_kind string, instrument string, language string, source_status string, opens_on date, deadline_on date, "
    "deadline_model string, total_budget decimal(20,2), grant_max decimal(20,2), funding_rate decimal(5,2), "
    "currency string, eligibility_text string, geographic_scope string, detail_level string, "
    "quality_flags array<string>, deadlines array<struct<due_on:date,due_at:timestamp_ntz,original:string,timezone:string>>, "
    "tags array<struct<kind:string,value:string,basis:string>>, _corrupt string"
)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON files with a fixed schema; a broken file fails instead of giving an empty row."""
    reader = spark.read.schema(schema).option("multiLine", multi_line)
    if "_corrupt" in schema:
        return reader.option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return reader.option("mode", "FAILFAST").json(path)


def read_search(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected lines) of landed search responses; an unreadable line costs no other."""
    # Parsed once, with lists as metadata: rejects alone cannot be read from JSON files, and behind the stage
    # each filter and field of the documents would parse all values again.
    lines = materialise(read_json(spark, path, SEARCH_LINE).withColumn("metadata", listed_values(F.col("metadata"))), "zstd")
    documents = lines.filter("_corrupt IS NULL").drop("_corrupt")
    rejected = lines.filter("_corrupt IS NOT NULL").select(
        F.col("_corrupt").alias("raw"), F.lit("Unreadable search response line").alias("reason"))
    return documents, rejected


def fail_unless(condition: Column, value: Column, message: str) -> Column:
    """``value`` where the condition holds; otherwise the job stops with the message."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))
