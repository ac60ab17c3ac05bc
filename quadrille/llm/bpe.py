"""BPE encoding and decoding of whole texts by tree concatenation.

A text of over ``TEXT_LEAF`` bytes is halved, unsplit and wherever the middle
falls, inside a word too, until the parts are small. All parts of a batch of
texts are encoded together, each distinct word of them once (bounded caches).
Then each join, level by level, encodes a window around the seam again, which
grows until its first and its last word have the tokens that both sides have
there. The tokenizer's own splitting never crosses ASCII white space, so where
both sides agree on a whole word beyond the seam, all that lies further out is
exact. A part without white space waits until a join meets some.

A single run that the pre-tokenizer leaves whole and that is longer than
``LEAF`` symbols is a tree of its own: there tokens that are valid pairwise make
a valid sequence, so agreement of the window's outer tokens makes the whole
exact. Tokenizers of another kind than those the fast path knows (``usual``)
are left to the library, text by text.

Results for odd input: a null text counts as empty, and an empty text has no
tokens; equal texts give equal rows, all returned; an empty table gives an
empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.models import BPE

from quadrille.storage import bounded_batches

#: Bytes of a text that is not halved any further.
TEXT_LEAF = 1024
#: Bytes to each side of a seam that a join tries first.
FIRST_WINDOW = 48
#: Symbols in a leaf of a run's tree; shorter runs are encoded in one piece.
LEAF = 512
#: Words and pieces that a worker remembers before it starts afresh.
MAX_WORDS = 800_000
MAX_PIECES = 800_000
#: The same where workers keep other models too (stages of a pipeline reuse them).
FEW_WORDS = 300_000

#: Below this code point normalisation and character classes are the same in every Unicode version.
_SIMPLE = 0x180


def _char_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_SIMPLE) if unicodedata.category(chr(c)).startswith(kind))


_L, _N = _char_class("L"), _char_class("N")
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{re.escape(_BLANKS)}{_L}{_N}]+")
_IS_SIMPLE = re.compile(f"[^\\u0130\\u{_SIMPLE:04x}-\\U0010ffff]*").fullmatch


def byte_symbols() -> dict[int, str]:
    """The printable symbol that byte-level BPE shows for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return table


_SYMBOL = {chr(b): s for b, s in byte_symbols().items()}
_BLANK = re.compile(rb"[\x09-\x0d ]")
_BLANK_BYTES = [bytes([c]) for c in b"\t\n\x0b\x0c\r "]
_TABLE = str.maketrans({k: v for k, v in _SYMBOL.items() if k != v})


class Memo(dict):
    """A bounded dict that fills itself; what was read lately survives when it starts a new generation."""

    def __init__(self, make, most: int, longest: int = 96):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most // 2, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class TreeBPE:
    """Exact BPE of one long symbol string by halves."""

    def __init__(self, spec: dict, whole: Tokenizer, leaf: int = LEAF):
        self.leaf = leaf
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.last = whole.model
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.open = Tokenizer(BPE(vocab=spec["model"]["vocab"], merges=merges))
        ending = {"end_of_word_suffix": self.suffix} if self.suffix else {}
        self.closed = Tokenizer(BPE(vocab=spec["model"]["vocab"], merges=merges, **ending))

    def _spans(self, tokens: list[str], closed: bool) -> list[int]:
        """Symbols that each token covers."""
        sizes = [len(t) for t in tokens]
        if closed and sizes and self.suffix:
            sizes[-1] -= len(self.suffix)
        return sizes

    def _encode(self, parts: list[tuple[str, bool]]) -> list[list[tuple[int, int]]]:
        """(id, symbols covered) of each part; closed parts end the word. Leaves run in parallel in the library."""
        out: list = [None] * len(parts)
        for kind in (False, True):
            at = [i for i, p in enumerate(parts) if p[1] is kind]
            model = self.closed if kind else self.open
            for i, e in zip(at, model.encode_batch([parts[i][0] for i in at], add_special_tokens=False), strict=True):
                out[i] = list(zip(e.ids, self._spans(e.tokens, kind), strict=True))
        return out

    def _join(self, text: str, left: list, right: list, lo: int, mid: int, hi: int, closed: bool) -> list:
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            start, end = mid - sum(n for _, n in a), mid + sum(n for _, n in b)
            final = closed and end == hi
            window = self._encode([(text[start:end], final)])[0]
            left_ok = len(a) == len(left) or (window and window[0] == a[0])
            right_ok = len(b) == len(right) or (window and window[-1] == b[-1])
            if left_ok and right_ok and len(window) > 1 or len(a) == len(left) and len(b) == len(right):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def encode(self, text: str) -> list[int]:
        cuts = list(range(0, len(text), self.leaf)) + [len(text)]
        if len(cuts) > 2 and cuts[-1] - cuts[-2] < 2:  # a last leaf of one symbol joins its neighbour
            cuts.pop(-2)
        spans = list(zip(cuts, cuts[1:], strict=False))
        nodes = self._encode([(text[a:b], b == len(text)) for a, b in spans])
        while len(nodes) > 1:
            joined, merged = [], []
            for i in range(0, len(nodes) - 1, 2):
                (a, m), (_, b) = spans[i], spans[i + 1]
                joined.append(self._join(text, nodes[i], nodes[i + 1], a, m, b, b == len(text)))
                merged.append((a, b))
            if len(nodes) % 2:
                joined.append(nodes[-1])
                merged.append(spans[-1])
            nodes, spans = joined, merged
        return [i for i, _ in nodes[0]]


class WordEncoder:
    """Encodes words that hold no ASCII white space exactly as the library encodes them in a text."""

    def __init__(self, path: str, leaf: int = LEAF, words: int = MAX_WORDS, pieces: int = MAX_PIECES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.leaf = leaf
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.model = self.whole.model
        self.tree = TreeBPE(spec, self.whole, leaf)
        self.vocab_size = self.whole.get_vocab_size()
        self.tokens = [self.whole.id_to_token(i) for i in range(self.vocab_size)]
        self.pieces = Memo(self._piece, pieces)
        self.words = Memo(self._packed, words)
        self.usual = self._is_usual(spec)

    @staticmethod
    def _is_usual(spec: dict) -> bool:
        """The fast path knows this normalizer and pre-tokenizer; others go through the library."""
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return kinds == ["NFC", "Replace", "Lowercase"] and [p["pattern"] for p in split] == [{"Regex": pattern}]

    def _symbols(self, symbols: str) -> list[int]:
        return self.tree.encode(symbols) if len(symbols) > self.leaf else [t.id for t in self.model.tokenize(symbols)]

    def _piece(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_TABLE)
        return np.array(self._symbols(symbols), "<u4").tobytes()

    def _packed(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a word."""
        if self.usual and _IS_SIMPLE(text):
            if text.isalpha():
                return self.pieces[text.lower()]
            head, tail = text[:-1], text[-1:]
            if head.isalpha() and tail in ".,;:!?":
                return self.pieces[head.lower()] + self.pieces[tail]
            if not any(s in text for s in self.specials):
                return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        return np.array(self._library(text), "<u4").tobytes()

    def _library(self, text: str) -> list[int]:
        if len(text) <= self.leaf or not self.usual or any(s in text for s in self.specials):
            return self.whole.encode(text, add_special_tokens=False).ids
        normal = self.whole.normalizer.normalize_str(text)
        return [i for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal) for i in self._symbols(p)]

    def encode(self, word: str) -> list[int]:
        return np.frombuffer(self.words[word], "<u4").tolist()

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and where each text's ids start (one more entry than texts).

        White space is cut and distinct words are found in native code; Python
        sees each distinct word of the batch once.
        """
        if not self.usual:
            coded = self.whole.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)
            return np.array([i for e in coded for i in e.ids], "<u4"), np.cumsum([0, *(len(e.ids) for e in coded)])
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        cuts = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        packed = pa.array(list(map(self.words.__getitem__, coded.dictionary.to_pylist())), pa.large_binary())
        if not len(packed):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        flat = packed.take(coded.indices)
        _, offsets, data = flat.buffers()
        ends = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
        ids = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<u4") if data is not None else np.zeros(0, "<u4")
        return ids, (ends[cuts - cuts[0]] - ends[0]) // 4


class TextTree:
    """Exact encoding of texts by halves that are cut anywhere; node values are packed ids, None for a run without white space."""

    def __init__(self, enc: WordEncoder, leaf: int = TEXT_LEAF, window: int = FIRST_WINDOW):
        self.enc, self.leaf, self.window = enc, leaf, window
        self.joins = 0

    def _words(self, raw: bytes) -> list[bytes]:
        return [self.enc.words[w.decode()] for w in raw.split()]

    def _join(self, data: bytes, left: bytes | None, right: bytes | None, a: int, mid: int, b: int) -> bytes:
        self.joins += 1
        width = self.window
        while True:
            lo, hi = mid - width, mid + width
            width *= 2
            if left is None or lo <= a:
                start, before = a, self._words(data[a:mid]) if left is not None else []
            else:
                blank = _BLANK.search(data, lo, mid)
                if not blank or not _BLANK.search(data, blank.end(), mid):
                    continue
                start = blank.end()
                before = self._words(data[start:mid])
            if right is None or hi >= b:
                end, after = b, self._words(data[mid:b]) if right is not None else []
            else:
                end = max(data.rfind(c, mid, hi) for c in _BLANK_BYTES)
                if end < 0 or not _BLANK.search(data, mid, end):
                    continue
                after = self._words(data[mid:end])
            window = self._words(data[start:end])
            n_before, n_after = sum(map(len, before)), sum(map(len, after))
            # the ends of a side need no witness: what the window holds up to there is all there is
            agree_left = start == a or (window and left.startswith(window[0], len(left) - n_before))
            agree_right = end == b or (window and right.endswith(window[-1], 0, n_after))
            if agree_left and agree_right:
                return b"".join(((left or b"")[: len(left or b"") - n_before], *window, (right or b"")[n_after:]))

    def _cuts(self, data: bytes) -> list[int]:
        """Bounds of the parts: halves of halves, moved back to where a character starts."""
        parts = 1
        while len(data) > self.leaf * parts:
            parts *= 2
        cuts = [0]
        for k in range(1, parts):
            at = len(data) * k // parts
            while data[at] & 0xC0 == 0x80:
                at -= 1
            if at > cuts[-1]:
                cuts.append(at)
        return [*cuts, len(data)]

    def _grow(self, data: bytes, cuts: list[int], nodes: list[bytes | None]) -> bytes:
        while len(nodes) > 1:
            joined, merged = [], []
            for i in range(0, len(nodes) - 1, 2):
                a, mid, b = cuts[i : i + 3]
                plain = nodes[i] is None and nodes[i + 1] is None
                joined.append(None if plain else self._join(data, nodes[i], nodes[i + 1], a, mid, b))
                merged.append(a)
            if len(nodes) % 2:
                joined.append(nodes[-1])
                merged.append(cuts[-2])
            nodes, cuts = joined, [*merged, cuts[-1]]
        return b"".join(self._words(data)) if nodes[0] is None else nodes[0]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As WordEncoder.encode_texts."""
        if not self.enc.usual:
            return self.enc.encode_texts(texts)
        raw = [t or b"" for t in texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
        cuts = [self._cuts(t) for t in raw]
        parts = pa.array([t[a:b] for t, c in zip(raw, cuts, strict=True) for a, b in zip(c, c[1:], strict=False)], pa.large_binary())
        ids, starts = self.enc.encode_texts(parts.cast(pa.large_string()))
        packed, bounds = ids.tobytes(), (starts * 4).tolist()
        out, at = [], 0
        for t, c in zip(raw, cuts, strict=True):
            n = len(c) - 1
            nodes = [packed[bounds[k] : bounds[k + 1]] for k in range(at, at + n)]
            if n > 1:
                nodes = [x if _BLANK.search(t, a, b) else None for x, a, b in zip(nodes, c, c[1:], strict=False)]
                nodes = [self._grow(t, c, nodes)]
            out.append(nodes[0])
            at += n
        return np.frombuffer(b"".join(out), "<u4"), np.cumsum([0, *(len(x) // 4 for x in out)])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def local_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _resolve(path: str) -> str:
    return path if "/" in path else local_path(path)


class Digests:
    """Digests of ids and of decoded text, from whole batches."""

    def __init__(self, path: str):
        self.enc = WordEncoder(path, words=FEW_WORDS, pieces=FEW_WORDS)
        self.tree = TextTree(self.enc)
        self.decimal = pa.array([f"{i} ".encode() for i in range(self.enc.vocab_size)], pa.large_binary())
        self.shown = pa.array([f"{t} ".encode() for t in self.enc.tokens], pa.large_binary())

    @staticmethod
    def _joined(table: pa.Array, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """Digest of each text's entries of ``table``, without the last blank."""
        flat = table.take(pa.array(ids))
        _, offsets, data = flat.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(flat) + 1][starts].tolist()
        view = memoryview(data) if data is not None else b""
        return [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]

    def rows(self, texts: pa.Array, with_ids: bool = False) -> list[pa.Array]:
        """Columns n_tokens, ids_sha256, decoded_sha256, and ids if asked for."""
        ids, starts = self.tree.encode_texts(texts)
        hashed = [pa.array(self._joined(t, ids, starts), pa.string()) for t in (self.decimal, self.shown)]
        kept = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))] if with_ids else []
        return [pa.array(np.diff(starts), pa.int64()), *hashed, *kept]


@lru_cache(maxsize=2)
def digests(path: str) -> Digests:
    return Digests(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: token count, digest of its ids, digest of the text decoded from them; the ids too if asked for.

    ``tokenizer`` is a path that every executor can open, or the name of a
    vocabulary file installed with the workers' Python.
    """
    bounded_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    fields = [picked.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = digests(_resolve(tokenizer))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *d.rows(batch.column(1), with_ids)], names)

    return picked.mapInArrow(work, T.StructType(fields))


TOKENIZER = "word_bpe_49k.json"


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests."""
    return encode_decode(docs, TOKENIZER, with_ids=True)
