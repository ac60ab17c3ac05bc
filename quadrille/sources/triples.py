"""Readers that run on executors: N-Triples and N-Quads by line, N3 and RDF/XML by file, tables by row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import terms
from quadrille.plans.data import QUADS, Table, unfold

_LINE = (
    r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:[^\s.]+(?:\.[^\s.]+)*|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
    r"\s*(<[^>]*>|_:[^\s.]+)?\s*\.\s*(?:#.*)?$"
)


def unescape(c: Column) -> Column:
    """N-Triples escapes undone by built-in functions: long ones by UTF-32, the others as JSON's."""
    pieces = F.split(c, r"(?<=(?<!\\)(?:\\\\){0,20})\\U", -1)
    long_ones = F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.concat(F.decode(F.unhex(F.substring(p, 1, 8)), "UTF-32"), F.substring(p, F.lit(9), F.length(p))),
    )
    joined = F.concat(F.get(pieces, F.lit(0)), F.array_join(long_ones, ""))
    as_json = F.replace(joined, F.lit("\\'"), F.lit("'"))
    as_json = F.replace(F.replace(as_json, F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    text = F.get(F.from_json(F.concat(F.lit('["'), as_json, F.lit('"]')), "array<string>"), F.lit(0))
    return F.when(c.contains("\\"), text).otherwise(c)


def _term(c: Column) -> Column:
    body = F.regexp_extract(c, r'(?s)^"(.*)"(@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    suffix = F.regexp_extract(c, r'(?s)^"(.*)"(@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 2)
    return F.when(c.startswith('"'), F.concat(F.lit('"'), unescape(body), F.lit('"'), suffix)).when(c.startswith("<"), unescape(c)).otherwise(c)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Quads of N-Triples or N-Quads lines; blank lines and comments are skipped.

    Lines that are neither have null in s: filter or count them with ``s is null``.
    """
    c = F.col(column)
    kept = lines.where(~c.rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract(c, _LINE, k)
    fine = F.regexp_like(c, F.lit(_LINE))
    return kept.select(
        F.when(fine, part(4)).otherwise("").alias("g"),
        F.when(fine, _term(part(1))).alias("s"),
        F.when(fine, _term(part(2))).alias("p"),
        F.when(fine, _term(part(3))).alias("o"),
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Quads of N-Triples or N-Quads files; malformed lines stop the job."""
    rows = parse_lines(spark.read.text(path))
    bad = F.raise_error(F.lit("a line is no N-Triples statement"))
    return rows.withColumn("s", F.when(F.col("s").isNull(), bad.cast("string")).otherwise(F.col("s")))


def read_documents(spark: SparkSession, path: str, kind: str = "n3") -> DataFrame:
    """Quads of many N3 or RDF/XML files, one task's memory holding one file at a time; blank nodes stay apart by file."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from quadrille.sources import n3, rdfxml

        for batch in batches:
            for text, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = "f" + hashlib.sha256(file.encode()).hexdigest()[:12] + "_"
                f = (rdfxml if kind == "rdf" else n3).parse(text, file, prefix)
                found = n3.rows(f)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string()) for i in range(4)], ["g", "s", "p", "o"])

    return files.select("value", "file").mapInArrow(work, QUADS)


def local_name(heading: str, place: int) -> str:
    """A heading as a predicate's name: first letter small, no blanks; a blank heading by its column's letter."""
    words = re.sub(r"[^A-Za-z0-9]+", " ", heading).split()
    if not words:
        return chr(ord("A") + place % 26)
    name = "".join([words[0], *[w[:1].upper() + w[1:] for w in words[1:]]])
    return name[:1].lower() + name[1:]


def table_to_quads(df: DataFrame, namespace: str, class_name: str = "Item", id_column: str | None = None) -> DataFrame:
    """Rows of a table of texts as quads: headings are predicates, empty cells and empty dates are skipped.

    A row is a blank node, or <namespace + id> with ``id_column``.
    """
    columns = df.columns
    row = F.concat(F.lit("_:row"), F.hex(F.xxhash64(*columns)), F.lit("_"), F.monotonically_increasing_id().cast("string"))
    subject = terms.iri_key(F.concat(F.lit(namespace), F.url_encode(F.col(f"`{id_column}`").cast("string")))) if id_column else row
    cells = [F.struct(F.lit(f"<{namespace}{local_name(c, i)}>").alias("p"), F.col(f"`{c}`").cast("string").alias("x")) for i, c in enumerate(columns)]
    typed = F.struct(F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>").alias("p"), F.lit(None).cast("string").alias("x"))
    rows = df.select(subject.alias("s"), F.explode(F.array(typed, *cells)).alias("c"))
    rows = rows.where("c.x is null and c.p like '%#type>' or (c.x is not null and trim(c.x) not in ('', '0/0/00'))")
    obj = F.when(F.col("c.x").isNull(), F.lit(f"<{namespace}{class_name}>")).otherwise(terms.literal_key(F.col("c.x")))
    return rows.select(F.lit("").alias("g"), "s", "c.p", obj.alias("o"))


def read_csv(spark: SparkSession, path: str, namespace: str, sep: str = ",", **how) -> DataFrame:
    return table_to_quads(spark.read.csv(path, header=True, sep=sep, inferSchema=False), namespace, **how)


def read_json(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """JSON lines: top-level fields are predicates, numbers and booleans keep their types."""
    df = spark.read.json(path).withColumn("__row", F.monotonically_increasing_id())
    plain = [c for c, k in df.dtypes if k in ("string", "bigint", "double", "boolean") and c != "__row"]
    return as_namespace(Table("json", df.select("__row", *plain), key="__row"), namespace)


def as_namespace(table: Table, namespace: str) -> DataFrame:
    """A table's quads with predicates in a namespace instead of the table's own, without its key."""
    rows = unfold(table).where(F.col("p") != table.predicate(table.key or ""))
    local = F.regexp_extract("p", r"#([^>]*)>$", 1)
    return rows.withColumn("p", F.concat(F.lit(f"<{namespace}"), local, F.lit(">")))


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, points_at: dict[str, str] | None = None, **options: str) -> Table:
    """A database table as a table of rows seen as triples; Spark pushes filters and columns to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    for k, v in options.items():
        reader = reader.option(k, v)
    return Table(name, reader.load(), key, points_at or {})
