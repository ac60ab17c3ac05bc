"""Line-first cleaning: judge every line, drop failing lines, then judge what is left.

A line fails if it equals an earlier line, if a fifth of its words are menu
signs, if it has at most ``SHORT`` words and holds a boilerplate phrase (English,
German, French or Spanish; a longer line is prose that mentions one), if three
tenths of its words are runs of signs, or if it neither ends nor contains a
sentence's end. A document fails by its words alone (the base rule), or if its
failing lines held over half of its word characters.

Results for odd input: a null or empty text has no words, fails the base rule
and is dropped; a text of any length is read whole; repeated rows are judged
alike and all returned; an empty table gives an empty table; columns other than
the named text column pass through untouched whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quadrille.storage import bounded_batches

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document must keep this share of its word characters once failing lines are gone.
MIN_KEPT_SHARE = 0.5
#: Words of the longest line that a boilerplate phrase condemns.
SHORT = 40

MENU_SIGNS = ("|", "»", "›", "•", "::", ">")
ENDS = r"[.!?…:;。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
SENTENCE = r"[.!?…。！？][\"'”’»)\]]*[\x20\x09-\x0D]+[^\x20\x09-\x0D]"
NOISY = r"[#*$%&<>|~^=_]{2,}|[!?]{2,}"
BOILERPLATE = (
    r"\b(?:all rights reserved|privacy policy|cookie policy|terms (?:of|and) (?:use|service|conditions)|"
    r"(?:enable|requires?) javascript|accept (?:all )?cookies|we use cookies|click here|"
    r"skip to (?:main )?content|subscribe to our|sign up for our|share (?:this )?on|back to top|"
    r"licen[sc]ed under|released under the|lorem ipsum|"
    r"alle rechte vorbehalten|cookie-richtlinie|nutzungsbedingungen|hier klicken|zum inhalt springen|newsletter abonnieren|"
    r"tous droits r.serv.s|politique de confidentialit.|conditions d'utilisation|cliquez ici|aller au contenu|"
    r"todos los derechos reservados|pol.tica de (?:privacidad|cookies)|t.rminos de uso|haga clic aqu.|saltar al contenido)|©|\(c\) (?:19|20)\d\d"
)

_ENDS, _SENTENCE, _NOISY = re.compile(ENDS), re.compile(SENTENCE), re.compile(NOISY)
_BOILERPLATE = re.compile(BOILERPLATE, re.IGNORECASE | re.ASCII)
_MENU_SIGNS = frozenset(x.encode() for x in MENU_SIGNS)

MEASURES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("n_lines_removed", T.LongType()),
        T.StructField("kept_chars", T.LongType()),
    ]
)


def repeat_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside any n-word window that occurs at least twice; exact, by successive ranking."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    v = len(number)
    key, top = ids[:m], v
    for k in range(1, n):
        if top * v >= 2**62:
            _, key = np.unique(key, return_inverse=True)
            top = int(key.max()) + 1
        key = key * v + ids[k : k + m]
        top *= v
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    if not twice.size:
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[twice] += 1
    edge[twice + n] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_fails(line: str, words: list[bytes]) -> bool:
    """True for navigation, boilerplate, symbol noise, shouting and unpunctuated fragments."""
    if 5 * sum(w in _MENU_SIGNS for w in words) >= len(words):
        return True
    if len(words) <= SHORT and _BOILERPLATE.search(line):
        return True
    if 10 * len(_NOISY.findall(line)) >= 3 * len(words):
        return True
    return not _ENDS.search(line) and not _SENTENCE.search(line)


def clean(text: str | None) -> tuple[tuple, str]:
    """The measures of MEASURES and the text without its failing lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    packed = b"".join(words)
    # continuation bytes are 10xxxxxx; what is left counts code points
    word_chars = len(packed.decode("utf-8", "surrogatepass"))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[str] = set()
    dups = removed = kept_chars = 0
    out = []
    for line in (text or "").split("\n"):
        line_words = line.encode("utf-8", "surrogatepass").split()
        if not line_words:
            out.append(line)
            continue
        again = line in seen
        dups += again
        seen.add(line)
        if again or line_fails(line, line_words):
            removed += 1
        else:
            kept_chars += len(b"".join(line_words).decode("utf-8", "surrogatepass"))
            out.append(line)
    n_repeat = repeat_words(words)
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    kept = not base_failed and kept_chars >= MIN_KEPT_SHARE * word_chars
    return (n_words, word_chars, n_symbols, dups, n_repeat, base_failed, kept, removed, kept_chars), "\n".join(out)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the columns of MEASURES."""
    bounded_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", picked.schema["doc_id"].dataType), *MEASURES])
    names = [f.name for f in MEASURES]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
        for batch in batches:
            rows = [clean(t)[0] for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return picked.mapInArrow(work, schema)


def apply_cleaning(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """Documents that pass, without their failing lines; same columns as ``docs``."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [clean(t) for t in batch.column(at).to_pylist()]
            keep = pa.array([m[6] for m, _ in done], pa.bool_())
            columns = list(batch.columns)
            columns[at] = pa.array([t for _, t in done], batch.schema.field(at).type)
            if chars_at is not None:
                columns[chars_at] = pa.array([len(t) for _, t in done], pa.int64()).cast(batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    return docs.mapInArrow(work, docs.schema)


def op3_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_cleaning(docs)


def _oracle_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    signs = ", ".join(map(quoted, MENU_SIGNS))
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
lines as (select rid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
worded as (select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as words from lines),
judged as (select *, row_number() over (partition by rid, line order by i) > 1 as again, len(words) as n,
    5 * len(list_filter(words, lambda w: w in ({signs}))) >= len(words)
    or (len(words) <= {SHORT} and regexp_matches(line, {quoted("(?i)" + BOILERPLATE)}))
    or 10 * len(regexp_extract_all(line, {quoted(NOISY)})) >= 3 * len(words)
    or not (regexp_matches(line, {quoted(ENDS)}) or regexp_matches(line, {quoted(SENTENCE)})) as fails,
    length(array_to_string(words, '')) as chars from worded where len(words) > 0),
by_doc as (select rid, sum(chars)::bigint as word_chars, count(*) filter (where again) as n_dup_lines, count(*) filter (where again or fails) as n_lines_removed,
    coalesce(sum(chars) filter (where not again and not fails), 0)::bigint as kept_chars from judged group by rid),
words as (select rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i from d),
windows as (select rid, i, case when lead(i, {WINDOW - 1}) over o is not null then
    concat_ws(' ', w, {", ".join(f"lead(w, {k}) over o" for k in range(1, WINDOW))}) end as key from words window o as (partition by rid order by i)),
twice as (select rid, i, key is not null and count(*) over (partition by rid, key) > 1 as twice from windows),
marked as (select rid, max(twice) over (partition by rid order by i rows between {WINDOW - 1} preceding and current row) as m from twice),
counted as (select rid, count(*) as n_words, count(*) filter (where m) as n_repeat_words from marked group by rid),
whole as (select d.doc_id, coalesce(c.n_words, 0) as n_words, coalesce(b.word_chars, 0) as word_chars,
    length(d.text) - length(translate(d.text, '{SYMBOLS.decode()}', '')) as n_symbols, coalesce(b.n_dup_lines, 0) as n_dup_lines,
    coalesce(c.n_repeat_words, 0) as n_repeat_words, coalesce(b.n_lines_removed, 0) as n_lines_removed, coalesce(b.kept_chars, 0) as kept_chars
  from d left join by_doc b using (rid) left join counted c using (rid))
select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and kept_chars >= {MIN_KEPT_SHARE} * word_chars as kept
from whole
"""


ORACLE_SQL = _oracle_sql()
