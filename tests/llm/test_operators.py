"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd input."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrille.llm import bpe, langid, mixing, quality, records, sharding, simhash, toxicity, vectors
from quadrille.storage import fresh_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet. " * 20_000
ODD = [
    (1, None, "en", "a", 1.5),
    (2, "", None, None, 1.5),
    (3, " \t\n ", "en", "b", None),
    (4, "one two", "en", None, 0.0),
    (5, "one two", "en", "a", 0.0),
    (5, "one two", "en", "a", 0.0),
    (6, "Ärger ퟿ 日本語 ﬁ ½ " * 30 + "it's 'tis\n\n#*$%&|<>", "de", "b", 0.0),
    (None, "no id here, but plenty of words to keep it going on and on.", "en", "b", 0.0),
    (7, LONG, "en", "a", 0.0),
    (8, "x" * 5000, "en", "a", 0.0),
]
SCHEMA = "doc_id long, text string, lang string, source string, start double"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- op2 ---------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, left, target = sum(sizes.values()), set(sizes), {}
    while left:
        share = total - sum(target.values())
        over = {s for s in left if share * weight[s] / sum(weight[x] for x in left) > 3 * sizes[s]}
        if not over:
            return target | {s: share * weight[s] / sum(weight[x] for x in left) for s in left}
        target |= {s: 3 * sizes[s] for s in over}
        left -= over
    return target


def block_of(sizes):
    return max(1, min(64, min((n for n in sizes.values() if n), default=64) // 64))


def test_mixing_serves_small_sources(spark):
    """Sources of a few words, alone and beside a hot one, come near their targets; every seat's shard is given."""
    small = [(100 * s + i, f"s{s:02d}", 5) for s in range(60) for i in range(4)]
    for rows in (small, small + [(10_000 + i, "hot", 400) for i in range(50)]):
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
        taken, target = Counter(), {}
        for r in got:
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert bool(r["shards"]) == (r["taken"] > 0) and r["taken"] <= 3 * r["size"]
            assert all(0 <= s < mixing.SHARDS for s in r["shards"])
        assert sum(taken.values()) == sum(n for _, _, n in rows)
        assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_mixing_targets_and_quotas(spark, docs, odd):
    for table in (docs, odd):
        sized = table.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"))
        rows = mixing.mix(sized).collect()
        assert len(rows) == table.count()
        sizes = defaultdict(int)
        for r in rows:
            sizes[r["source"]] += r["size"]
        want = brute_targets(dict(sizes))
        taken = Counter()
        for r in rows:
            assert r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(want[r["source"]])
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        block = block_of(sizes)
        for s, t in want.items():
            assert abs(taken[s] - t) <= 3 * block
        again = mixing.mix(sized).collect()
        key = lambda r: (r["doc_id"] is None, r["doc_id"], r["taken"])
        assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mixing_counts_words(docs):
    got = {r[0]: r[1] for r in docs.select("doc_id", mixing.words_in(F.col("text"))).collect()}
    assert all(got[i] == len(WORD.findall(t or "")) for i, t in texts_of(docs))


def test_apportionment_is_sainte_lague(spark):
    sizes = {"a": 700, "b": 9000, "c": 40_000, "d": 2_500}
    table = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    target = {r["source"]: r["target"] for r in table.collect()}
    rows = mixing.apportion(mixing.with_blocks(table), shards=8).collect()
    block = block_of(sizes)
    whole = round(sum(target.values()) / block)
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    for upto in range(1, 9):
        seats = Counter()
        for _ in range(whole * upto // 8):
            best = max((s for s in sorted(sizes) if seats[s] < 3 * blocks[s]), key=lambda s: target[s] / (2 * seats[s] + 1))
            seats[best] += 1
        assert Counter({r["source"]: r["upto"] for r in rows if r["shard"] == upto - 1}) == seats


def test_mixing_stage_repeats_documents(spark, docs):
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    most = out.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= 3


# --- op3 ---------------------------------------------------------------------------------------------------------


def brute_measures(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            marked |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, dups, len(marked), failed


def test_quality_measures(docs, odd):
    for table in (docs, odd.where("doc_id != 7 or doc_id is null")):
        want = Counter((i, *brute_measures(t)) for i, t in texts_of(table))
        rows = quality.measure(table).collect()
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
        assert got == want
        assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_quality_removes_lines(spark):
    body = (
        "The river rose early this spring and took two footbridges with it.\n"
        "A baker in the upper village lost her whole supply of flour.\n"
        "Neighbours carried sacks across the meadow until late at night.\n"
        "By Sunday the water had gone, leaving reeds on every fence."
    )
    text = f"Home | About | Contact | Login\n{body}\nAll rights reserved. Privacy policy.\n$$ ## %% && <<\nread more here"
    measures, cleaned = quality.clean(text)
    assert measures[6] and cleaned == body
    assert not quality.clean("\n".join(["Home | News | Sport | Login"] * 2 + [f"menu item {i} and more" for i in range(30)]))[0][6]


def test_quality_stage_keeps_schema(spark, docs, odd):
    out = quality.stage(spark, odd, "")
    assert out.columns == odd.columns and out.count() <= odd.count()
    kept = quality.stage(spark, docs, "")
    bad = {r["doc_id"] for r in quality.measure(docs).collect() if not r["kept"]}
    assert not bad & {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())


# --- op4 ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.local_path(bpe.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    return t


def test_records_round_trip(spark, docs, odd, library):
    for table in (docs, odd):
        folder = fresh_path(spark, "records")
        manifest = records.write_records(table, bpe.TOKENIZER, folder)
        rows = sorted(records.read_digest(manifest).collect(), key=lambda r: r["start"])
        at = 0
        ids = sorted(texts_of(table), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
        for r, (doc_id, text) in zip(rows, ids, strict=True):
            want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(want), zlib.crc32(want.tobytes()))
            at += len(want)
        m = manifest.orderBy("shard").first()
        numbers = list(range(m["n_records"]))[::-1]
        back = list(records.fetch(m["path"], numbers))
        assert [i for i, _ in back][::-1] == [r["doc_id"] for r in rows if r["shard"] == m["shard"]]


def test_corrupt_record_is_noticed(spark, docs, tmp_path):
    manifest = records.write_records(docs.limit(5), bpe.TOKENIZER, f"file://{tmp_path}")
    path = manifest.first()["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[30] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(records.CorruptRecord):
        list(records.scan(f"file://{path}"))


# --- op5 ---------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def brute_components(prints):
    """doc index -> smallest doc_id reachable over links of at most three bits."""
    fp = [p for _, p in prints]
    up = list(range(len(fp)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fp))]


def test_simhash(docs, odd):
    for table in (docs, odd):
        prints = [(i, brute_print(t)) for i, t in texts_of(table)]
        want = Counter((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints), strict=True))
        got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table).collect())
        assert got == want


def test_simhash_links_through_hot_keys(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    near = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (60, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 40)}
    fps = sorted(near)
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    for hot in (3, 256):
        assert {(r["src"], r["dst"]) for r in simhash.links(table, hot_key=hot).collect()} == want


def test_simhash_stage_keeps_one(spark, docs):
    kept = [r["doc_id"] for r in simhash.stage(spark, docs, "").select("doc_id").collect()]
    assert sorted(kept) == sorted({r["component_id"] for r in simhash.near_duplicates(docs).collect()})


# --- op6 ---------------------------------------------------------------------------------------------------------


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        place = sharding.permute(np.arange(n), n, 5)
        assert sorted(place.tolist()) == list(range(n))
        assert sharding.unpermute(place, n, 5).tolist() == list(range(n))


def test_shards(spark, docs, sf_dir, odd):
    rows = sharding.op6_feistel_shards(spark, sf_dir).collect()
    text = dict(texts_of(docs))
    assert len(rows) == len(text)
    by_shard = defaultdict(list)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        by_shard[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    counts = [len(by_shard[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    odd_rows = sharding.assign(odd.select("doc_id", "text"), ["doc_id", "text"], 3).collect()
    assert sorted(r["row_number"] for r in odd_rows) == list(range(len(ODD)))


# --- op7, op8 ----------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"  # sf0.01 has 18 toxic rows in the held-out fold, too few to judge by
    rows = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, d).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(labels[i], rows[i]["score"]) for i in labels if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    pos, neg = [s for y, s in held if y], [s for y, s in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9
    assert sum(s >= 0.7 for s in pos) >= 0.75 * len(pos) and sum(s >= 0.7 for s in neg) <= 0.05 * len(neg)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())


def brute_toxicity(text, model):
    """A text's score word by word: buckets, means over words, the worst mean over neighbours."""
    worth = []
    for word in (text or "").split():
        b = b"<" + word.lower().strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum())).encode() + b">"
        for piece in [b] if len(b) <= 256 else [b[i : i + 48] for i in range(0, len(b) - 16, 32)]:
            grams = [piece] + [piece[i : i + n] for n in model.setting.ngrams for i in range(len(piece) - n + 1)]
            worth.append(0.0 if piece == b"<>" else float(np.mean([model.scores[zlib.crc32(g) % len(model.scores)] for g in grams])))
    w = min(model.setting.window, len(worth))
    worst = max((sum(worth[i : i + w]) / w for i in range(len(worth) - w + 1)), default=0.0) if w else 0.0
    return 1 / (1 + np.exp(-(4 * model.setting.window * worst + model.bias)))


def test_toxicity_scores_equal_brute_force(docs, odd):
    rng = np.random.default_rng(2)
    for window in (1, 2, 5):
        model = toxicity.Model(rng.normal(0, 0.3, toxicity.BUCKETS).astype("f4"), -1.0, toxicity.Setting((3, 4), window))
        for table in (docs.limit(60), odd.where("doc_id != 7 or doc_id is null")):
            for r, (i, t) in zip(toxicity.score(table, model).collect(), texts_of(table), strict=True):
                assert (r["doc_id"], r["predicted"]) == (i, int(r["score"] >= 0.7))
                assert r["score"] == pytest.approx(brute_toxicity(t, model), abs=1e-6)


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Ids that repeat in documents make no more rows to learn from."""
    monkeypatch.setattr(toxicity, "FIT_TOTAL", 20_000)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, *a: seen.append(texts) or toxicity.Model(np.zeros(4), 0.0))
    docs = spark.range(4000).selectExpr("id % 3 as doc_id", "repeat(concat('word', id, ' '), 10) as text", "1 as y", "2 as toxic")
    toxicity.fit(docs, spark.createDataFrame([(0, 1), (1, 0), (2, 0), (0, 0)], "doc_id long, toxic int"))
    assert 0 < sum(map(len, seen[0])) < 2 * toxicity.FIT_TOTAL


def test_toxicity_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(odd, none)).collect()} == {0.0}
    some = spark.createDataFrame([(3, 0), (4, 1), (5, 0), (6, 1), (6, None), (8, 0)], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.fit(odd, some)).collect()
    assert len(rows) == len(ODD)


def test_toxicity_reads_runs_to_their_end():
    """Words joined by signs or by wide blanks, and scripts without spaces, are read beyond their first bytes."""
    clean, bad = "the quiet garden path leads over a hill", "vilescum hatefiend"
    han, slur = "今天天气很好我们去公园散步然后回家吃饭", "恶毒辱骂词语"
    texts = [clean, f"{clean} {bad}", han * 20, han * 20 + slur + han] * 20
    scorer = toxicity.Scorer(toxicity.train(texts, [0, 1, 0, 1] * 20))
    score = lambda *t: scorer.score(pa.array(t)).tolist()
    for sign in ("_", ",", "%20"):
        a, b = (sign.join(t.split()) for t in (f"{clean} " * 30, f"{clean} " * 30 + bad + f" {clean}" * 30))
        a, b = score(a, b)
        assert b > a
    a, b = score(han * 40, han * 30 + slur + han * 10)
    assert a < toxicity.THRESHOLD <= b
    for blank in ("\u00a0", "\u3000"):
        spaced = f"{clean} " * 30 + bad
        assert score(spaced.replace(" ", blank)) == score(spaced)
        assert toxicity.Bags([spaced.replace(" ", blank)], (3,)).docs[0].tolist() == toxicity.Bags([spaced], (3,)).docs[0].tolist()
    run = "x" * 5000 + "日本" * 500
    found = toxicity.pieces(run)
    whole = b"<" + run.encode() + b">"
    for n in toxicity.SETTING.ngrams:
        assert {whole[i : i + n] for i in range(len(whole) - n + 1)} == {p[i : i + n] for p in found for i in range(len(p) - n + 1)}
    mixed = [f"{clean} {run} {bad}", "", run, None, clean]
    assert score(*mixed) == [score(t)[0] if t is not None else score("")[0] for t in mixed]


def test_language_held_out(spark, docs, odd):
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r["doc_id"]: r for r in langid.op8_hyperdimensional_language(spark, d).collect()}
    truth = {r["doc_id"]: r["lang"] for r in table.select("doc_id", "lang").collect()}
    held = [i for i in rows if rows[i]["held_out"] and truth[i] is not None and rows[i]["lang_pred"] != "und"]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    model = langid.fit(table)
    out = langid.identify(odd, model).collect()
    assert len(out) == len(ODD)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(odd.where("lang is null"))).collect()} == {"und"}


# --- op9 ---------------------------------------------------------------------------------------------------------


def test_bpe(docs, odd, library):
    for table in (docs, odd):
        want = Counter()
        for i, t in texts_of(table):
            ids = library.encode(t or "", add_special_tokens=False).ids
            shown = library.decode(ids, skip_special_tokens=False)
            want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())] += 1
        assert Counter(tuple(r) for r in bpe.encode_decode(table, bpe.TOKENIZER).collect()) == want


def test_text_tree_equals_whole(library, docs):
    """Joins of every kind: inside words, at white space, over runs without any; most of the table goes through them."""
    enc = bpe.WordEncoder(bpe.local_path(bpe.TOKENIZER))
    rng = np.random.default_rng(6)
    bits = ["the ", "a", "'s", "'", "é", "e\u0301", "\u0301", "ﬁ", "\n", "  ", "\u00a0", "日本", "\u2003", "<|endoftext|>", "123", "!!", "İ", "\u200d", "😀", "x" * 30, "\x85", "\x1c"]
    for leaf, window in ((8, 2), (16, 4), (64, 48)):
        tree = bpe.TextTree(enc, leaf, window)
        texts = ["".join(rng.choice(bits, int(rng.integers(0, 120)))) for _ in range(60)] + ["", None, "x" * 500, " " * 300]
        ids, starts = tree.encode_texts(pa.array(texts))
        assert tree.joins > 100
        for k, t in enumerate(texts):
            assert ids[starts[k] : starts[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t
    tree = bpe.TextTree(enc)
    texts = [t for _, t in texts_of(docs)]
    tree.encode_texts(pa.array(texts))
    assert tree.joins > len(texts)
    assert 2 * sum(len(t or "") for t in texts if len((t or "").encode()) > bpe.TEXT_LEAF) > sum(len(t or "") for t in texts)


def test_other_tokenizers_go_through_the_library():
    path = bpe.local_path("byte_bpe_50k.json")
    texts = ["  two blanks\n\nand 'more' of it", None, "ab " * 2000]
    ids, starts = bpe.TextTree(bpe.WordEncoder(path)).encode_texts(pa.array(texts))
    whole = Tokenizer.from_file(path)
    for k, t in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_tree_equals_whole(library):
    enc = bpe.WordEncoder(bpe.local_path(bpe.TOKENIZER), leaf=8)
    rng = np.random.default_rng(3)
    for size in (9, 16, 17, 63, 200, 1001):
        for letters in ("ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "!?-"):
            text = "".join(rng.choice(list(letters), size))
            assert enc.encode(text) == library.encode(text, add_special_tokens=False).ids, text


# --- op10 --------------------------------------------------------------------------------------------------------


def brute_vectors(rows, t):
    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if fine(a) and fine(b) and len(a) == len(b):
                a, b = np.array(a, float) / max(map(abs, a)), np.array(b, float) / max(map(abs, b))
                near[i][j] = near[j][i] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= t
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], sum(near[i]), min(ids) if ids else None))
    return Counter(out)


def near_rows(rng, n, dim, groups):
    centres = rng.normal(size=(groups, dim))
    return [(centres[k % groups] + rng.normal(size=dim) * 0.2 * rng.random()).astype("f4").tolist() for k in range(n)]


@pytest.mark.parametrize("tile", [7, 4096])
def test_embedding_duplicates(spark, tile):
    rng = np.random.default_rng(4)
    rows = list(enumerate(near_rows(rng, 150, 24, 12)))
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [1.0] * 23 + [None]), (1004, [1.0] * 23 + [float("nan")])]
    rows += [(1005, [1.0] * 23 + [float("inf")]), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [2.0, 4.0]), (1008, [2.0, 4.0]), (None, [4.0, 8.0])]
    rows += [(2000 + i, rows[3][1]) for i in range(5)] + [(1009, [1.0] + [0.0] * 39), (1010, [19.0] + [1.0] * 39), (1011, [1e30, 1e30])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit("clash")).withColumn("first", F.lit(0))
    got = vectors.near_duplicates(table, tile=tile).collect()
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_vectors(rows32, 0.95)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_close_pairs_and_forest():
    rng = np.random.default_rng(5)
    u = vectors.units(np.array(near_rows(rng, 400, 64, 9)))
    turned = (u @ vectors.principal_axes(u)).astype("f4")
    for t in (0.5, 0.9, 0.99):
        i, j = vectors.close_pairs(turned[:200], turned[200:], t, lambda a, b: np.einsum("ij,ij->i", u[a], u[200 + b]))
        want = np.argwhere(u[:200] @ u[200:].T >= t)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(map(tuple, want.tolist()))
        tree = vectors.spanning(i, j + 200, 400)
        whole, part = vectors.Forest(), vectors.Forest()
        n_whole = sum(whole.join(a, b) for a, b in zip(i.tolist(), (j + 200).tolist(), strict=True))
        assert n_whole == sum(part.join(a, b) for a, b in zip(i[tree].tolist(), (j[tree] + 200).tolist(), strict=True))


# --- all: empty tables -------------------------------------------------------------------------------------------


def test_empty_tables(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert mixing.mix(none.select("doc_id", "source", F.lit(0).cast("long").alias("size"))).count() == 0
    assert quality.measure(none).count() == 0
    assert records.read_digest(records.write_records(none, bpe.TOKENIZER, fresh_path(spark, "records"))).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert sharding.assign(none.select("doc_id"), ["doc_id"]).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert bpe.encode_decode(none, bpe.TOKENIZER).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    for module in (quality, langid, simhash, mixing, bpe):
        assert module.stage(spark, none, "").count() == 0


def test_arrow_text_types():
    """Scorers take both string widths."""
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0)
    for kind in (pa.string(), pa.large_string()):
        assert toxicity.Scorer(model).score(pa.array(["a b", None, ""], kind)).tolist() == [0.5] * 3
