"""Operators against brute force, the libraries or held-out labels, with nulls, empty and repeated rows."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent.parent))

from clausewise.llm import boosted, chroma, common, minhash, nn_descent, packing, pii, prefix_bpe, prefix_free, suffix_dedup, token_counts, toxicity, triggers

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " a", "a  b   c", "é ▁x\n\n\t b'll", "====" * 30, "aaaa" * 90, " " * 70, "日本語 𝒳 \x00 a", "x<|endoftext|> y", "ha" * 300, "<s> </s>"]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smallest table, odd ones, and repeated rows."""
    odd = spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(ODD)] + [(None, "a row without an id"), (90_000, "")], "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd).cache()


def test_token_counts_equal_the_library(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = sorted((r.doc_id or -1, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect()) == expected


def test_prefix_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    expected = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((r.doc_id or -1, len(ids), digest, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, *list(r)[1:]) for r in prefix_bpe.round_trip(docs, BPE).collect()) == sorted(expected)


def test_plain_personal_data_equals_the_patterns():
    random.seed(3)
    for _ in range(3000):
        text = "".join(random.choice("ab@@..1122334455 -+()_é") for _ in range(random.randint(0, 40)))
        expected = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        expected += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        expected += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
        expected += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.plain(text) == sorted(expected)


@pytest.mark.parametrize(
    ("text", "clear"),
    [
        ("mail john [at] example [dot] com now", "mail [EMAIL] now"),
        ("john dot doe at example dot com ok", "[EMAIL] ok"),
        ("call plus four nine one five one two three four five six seven eight now", "call [PHONE] now"),
        ("4111 1111 １111 1111!", "[CARD]!"),
        ("one nine two dot one six eight dot one dot one two.", "[IP]."),
        ("jоhn@exаmple.com", "[EMAIL]"),
        ("ann at host dot dev!", "[EMAIL]!"),
        ("escribe a ana arroba ejemplo punto es hoy", "escribe a [EMAIL] hoy"),
        ("ann\n at  my.host \ndot  dev", "[EMAIL]"),
        ("go to 192 dot 168 dot 0 dot 1 now", "go to [IP] now"),
        ("card 4111 one one one one 111 one 1111.", "card [CARD]."),
        ("we looked at this point in time", "we looked at this point in time"),
        ("see it at example.com and dot the page", "see it at example.com and dot the page"),
        ("1 2 3 4 5 6", "1 2 3 4 5 6"),
        ("we met at noon, one two three four times", "we met at noon, one two three four times"),
    ],
)
def test_disguises_are_mapped_back(text, clear):
    assert pii.redact(text, pii.find(text)[1]) == clear


def _plain_spans(text):
    """The contract's base spans by its own patterns."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    return sorted(found + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_personal_data_query_equals_the_patterns(docs):
    more = docs.sparkSession.createDataFrame([(1, "ann at host dot dev, 10.0.0.1"), (1, "a@b.cd a@b.cd +49 151 1234567"), (2, "x" * 9_000 + " a@b.c")], "doc_id long, text string")
    held = docs.union(more).withColumn("n_email", docs.doc_id)
    expected = []
    for r in held.collect():
        base = _plain_spans(r.text or "")
        kinds = Counter(k for _, k, _ in base)
        expected.append((r.doc_id or -1, *(kinds[k] for k in range(4)), hashlib.sha256(pii.written(base).encode()).hexdigest(), pii.written(pii.find(r.text or "")[1])))
    assert sorted((r.doc_id or -1, *list(r)[1:]) for r in pii.personal_data(held).collect()) == sorted(expected)
    assert ("email:0:19,ip:21:29") in [e[-1] for e in expected if e[0] == 1]


def test_redacted_keeps_rows_and_columns(spark):
    rows = [(1, "to a@b.cd", "k"), (1, "to a@b.cd", "k"), (None, None, None), (2, "", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    assert sorted(map(tuple, pii.redacted(docs).collect()), key=str) == sorted([(1, "to [EMAIL]", "k"), (1, "to [EMAIL]", "k"), (None, None, None), (2, "", "m")], key=str)


def test_suffix_dedup_equals_brute_force(spark):
    random.seed(5)
    base = ["".join(random.choice("abc dé") for _ in range(300)) for _ in range(6)]
    rows = [(1, "a" * 1000), (2, None), (3, ""), (4, "ab" * 300), (5, "x" * 199), (6, "y" * 200), (7, "y" * 200)]
    for k in range(80):
        parts = [(b := random.choice(base))[(i := random.randint(0, 120)) : i + random.randint(100, 280)] + "".join(random.choice("xyzé ") for _ in range(random.choice([0, 1, 5, 40]))) for _ in range(4)]
        rows.append((100 + k, "".join(parts)))
    rows += rows[-3:]
    seen = Counter(b[i : i + 200] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 199))
    expected = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        expected.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect())) == sorted(expected)


def _hot_key(rng, rows):
    """Fragments of one key: windows that hold a core of 90 bytes, amid some or many kinds of surroundings; and the core's places."""
    core = rng.integers(97, 123, 90)
    left, right = rng.integers(97, 123, (rows // 3, 110)), rng.integers(97, 123, (rows // 3, 200))
    fragments, lead = [], []
    for _ in range(rows):
        low, high = sorted(rng.integers(0, 111, 2))
        before = left[rng.integers(len(left))].copy()
        before[: rng.integers(0, 110)] = 98
        fragments.append(np.r_[before[110 - high :], core, right[rng.integers(len(right))]][: high - low + 200].astype(np.uint8).tobytes())
        lead.append(int(high))
    return fragments, lead


def test_blocks_of_a_hot_key_equal_brute_force():
    rng = np.random.default_rng(2)
    for rows in (12, 300):
        fragments, lead = _hot_key(rng, rows)
        seen = Counter(f[i : i + 200] for f in fragments for i in range(len(f) - 199))
        expected = [seen[f[i : i + 200]] > 1 for f in fragments for i in range(len(f) - 199)]
        data, offsets = np.frombuffer(b"".join(fragments), np.uint8), np.r_[0, np.cumsum([len(f) for f in fragments])]
        for block in (200, 3_000, 40_000):
            assert prefix_free.in_blocks(data, offsets, np.full(rows, -7), np.array(lead), block).tolist() == expected


@pytest.mark.parametrize("keys", [1, 500])
def test_memory_of_compared_windows_follows_no_batch_and_no_key(keys):
    """10,000 fragments come as one batch; their arrays take less than 150 MB (before: over 700)."""
    import tracemalloc

    fragments, lead = _hot_key(np.random.default_rng(4), 10_000)
    key = np.sort(np.arange(10_000) % keys)
    columns = [pa.array(key), pa.array(np.arange(10_000)), pa.array(np.arange(10_000)), pa.array(np.array(lead)), pa.array(fragments, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["key", "uid", "vid", "place", "bytes"])
    tracemalloc.start()
    got = sum(x.num_rows for x in common.by_key(iter([batch]), suffix_dedup._compared, 4096, prefix_free.BLOCK))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got and peak < 150e6


def test_runs_of_keys_are_smaller_than_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000) // 30), pa.array(["x" * 50] * 10_000)], names=["key", "text"])
    for least, limit in ((100, 1 << 25), (1 << 16, 6_000)):
        runs = []
        list(common.by_key(iter([batch, batch.slice(0, 0)]), lambda t: iter(runs.append(t.column(0).to_pylist()) or ()), least, limit))
        assert [x for run in runs for x in run] == batch.column(0).to_pylist()
        assert max(map(len, runs)) < 300 and all(a[-1] < b[0] for a, b in zip(runs, runs[1:]))


def test_windows_of_short_texts_and_their_memory(spark):
    """Slices of less bytes than a span raised an error; windows of 1 MB took 71 MB."""
    import tracemalloc

    for n in range(0, 300, 7):
        windows = triggers.Windows(np.full(n, 97, np.uint8), np.array([0, n]))
        assert len(windows.at) == len(windows.first) == max(n - 199, 0)
    rows = [(1, "x" * 40), (2, "y" * 60), (3, "z" * 30)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == [(d, len(t), 0, hashlib.sha256(t.encode()).hexdigest()) for d, t in rows]
    data = np.random.default_rng(6).integers(97, 123, 1 << 20).astype(np.uint8)
    triggers.Windows(data, np.array([0, len(data)]))  # powers are kept
    tracemalloc.start()
    triggers.Windows(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6


def test_long_texts_come_in_segments(spark, monkeypatch):
    """One text of many segments, with a passage twice, across a border, and once in another text."""
    from clausewise.llm import triggers

    random.seed(8)
    noise = lambda n: "".join(random.choice("abcdefghij klmnop") for _ in range(n))
    passage = noise(900)
    rows = [(1, noise(9_600) + passage + noise(30_000) + passage + noise(500)), (2, "é" + passage[100:500]), (3, noise(400))]
    monkeypatch.setattr(triggers.segments, "__defaults__", (5_000,))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == {1: (1800, 2), 2: (400, 1), 3: (0, 0)}


def test_without_repeats_keeps_clashing_columns(spark):
    passage = "".join(random.choice("abcé ") for _ in range(300))
    names = "uid runs places spans vid of key c0".split()
    rows = [(1, "x" + passage + "y", *range(8)), (2, passage, *range(8)), (2, passage, *range(8)), (None, None, *range(8)), (3, "", *range(8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "xy", *range(8)), (2, "", *range(8)), (2, "", *range(8)), (None, None, *range(8)), (3, "", *range(8))], key=str)


def test_merged_runs_equal_single_bytes():
    rng = np.random.default_rng(1)
    for _ in range(200):
        runs = [int(a) << 28 | int(n) for a, n in zip(rng.integers(0, 60, 6), rng.integers(1, 12, 6), strict=True)]
        gone = np.zeros(80, bool)
        for r in runs:
            gone[r >> 28 : (r >> 28) + (r & 0xFFF)] = True
        begin, end = suffix_dedup.merged(runs)
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        assert begin.tolist() == edges[::2].tolist() and end.tolist() == edges[1::2].tolist()


def test_packing_of_very_long_blanks(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    texts = ["a" + " " * 1_200_000 + "b", "\n" * 1_100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter()
    for r in packing.best_fit(docs, BPE).collect():
        got[r.doc_id] += r.length
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_packing_has_no_gaps_and_keeps_every_piece(docs):
    got = packing.best_fit(docs, BPE).collect()
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * sum(r.length for r in got) / 1024 + 1
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    for r in docs.where("doc_id <> 90000").collect():
        ids, at = np.append(library.encode(r.text or "", add_special_tokens=False).ids, 2).astype("<u4"), 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.piece):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_near_duplicates_of_odd_rows(docs):
    got = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(docs).collect()}
    assert got[90_000, 0].component_id == 90_000
    assert got[None, 1].component_id is None and got[None, 1].kept


def test_candidates_count_in_the_first_shared_band_only():
    """Two classes that share the bucket of band 1; band 0 agrees in a byte of each value, but not in its key."""
    rng = np.random.default_rng(2)
    values, tags = rng.integers(0, 256, 2 * minhash.PERMUTATIONS, np.uint8), rng.integers(0, 256, 2 * minhash.BANDED // minhash.BAND, np.uint8)
    other, changed = values.copy(), tags.copy()
    other[10 : minhash.BANDED : 5] ^= 1
    changed[:2] ^= 1
    changed[4:] ^= 1
    names = "key t asks minor node n component sketch".split()
    for t, expected in ((1, True), (2, False)):
        rows = [(77, t, True, True, 5, 100, 5, np.r_[values, tags].tobytes()), (77, t, False, False, 9, 100, 9, np.r_[other, changed].tobytes())]
        table = pa.table({n: pa.array([r[i] for r in rows]) for i, n in enumerate(names)})
        assert minhash._candidates(table)[2].tolist() == [[expected]]


def _near_duplicates_by_brute_force(rows):
    """(doc_id, shingles, component_id) of each row, from all pairs of full sets."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return [(rows[i][0], len(sets[i]), least[group[i]]) for i in range(len(rows))], group


def _near_rows():
    """Groups whose pairs lie around the threshold, a chain, exact copies, repeated rows, null ids, odd texts."""
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefg") for _ in range(4))
    rows = []
    for g in range(4):
        base = [word() for _ in range(120)]
        for k in range(60):
            own = list(base)
            for _ in range(random.choice([0, 1, 2, 3, 4, 5, 8])):
                own[random.randrange(120)] = word()
            rows.append((1000 * g + k, " ".join(own)))
        chain = list(base)
        for k in range(20):
            chain[6 * k : 6 * k + 3] = [word(), word(), word()]
            rows.append((1000 * g + 500 + k, " ".join(chain)))
    rows += [(7000 + i, rows[5][1]) for i in range(10)] + [rows[0], rows[0], (1, "Ab c"), (1, "aB  C"), (None, "ab c"), (None, "so alone"), (8000, ""), (8001, None), (8000, ""), (8002, " \n\t"), (8003, "é")]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = _near_rows()
    expected, _ = _near_duplicates_by_brute_force(rows)
    docs = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)], "doc_id long, text string, node int").withColumnRenamed("node", "n_shingles").repartition(7)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=order) == sorted(((*r, r[0] == r[2]) for r in expected), key=order)


def test_blocks_of_a_hot_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = _near_rows()
    expected, _ = _near_duplicates_by_brute_force(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=order) == sorted(expected, key=order)


def test_one_of_each_decides_by_row(spark):
    """Rows (1, A) (1, A) (2, A) (2, B): one A and the B stay; rows without words all stay; extra columns may clash."""
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a, "x", 1), (1, a, "x", 1), (2, a, "x", 1), (2, b, "x", 1), (None, b, "y", 2), (3, "", "x", 1), (3, "", "x", 1), (4, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_low string, c int")
    got = sorted(((r.doc_id, r.text) for r in minhash.one_of_each(docs).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, ""), (3, ""), (4, None)], key=str)
    assert minhash.one_of_each(docs).columns == docs.columns
    assert minhash.one_of_each(docs.limit(0)).count() == 0


def test_signature_tags_name_the_bands(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "")], "doc_id long, text string")
    for r in minhash.signatures(docs).collect():
        tags = np.frombuffer(bytes(r.sketch), np.uint8)[2 * minhash.PERMUTATIONS :].view("<u2")
        assert tags.tolist() == ([b & 0xFFFF for b in r.bands] if r.n else [0] * len(tags))


def test_vectors_with_odd_rows_and_recall(spark):
    random.seed(1)
    rows = [(i, [random.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    rows += [(1000 + i, [x + random.gauss(0, 0.05) for x in rows[i % 5][1]]) for i in range(200)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, []), (2004, rows[0][1]), (None, rows[0][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    result = nn_descent.near_vectors(vectors).cache()
    assert result.count() == len(rows)
    assert {r.n_links for r in result.where("vec_id between 2000 and 2003").collect()} == {0}
    assert nn_descent.recall(vectors.where("vec_id is not null"), nn_descent.near_vectors(vectors.where("vec_id is not null")), step=1) >= 0.99


def test_full_lists_do_not_hide_a_bridge(spark):
    """Two groups of 200 vectors, each nearer to its own than to the bridge, that one pair of vectors links; eight times."""
    rng, rows = np.random.default_rng(6), []
    turned = lambda x, y, angle: np.cos(angle) * x + np.sin(angle) * y
    for g in range(8):
        axes = np.linalg.qr(rng.normal(size=(64, 64)))[0].T
        near, far = turned(axes[0], axes[1], -0.2), turned(axes[0], axes[1], 0.2)
        for side, (end, out) in enumerate(((near, -0.55), (far, 0.55))):
            centre = turned(axes[0], axes[1], out)
            group = [end, *(v / np.linalg.norm(v) for v in (centre + rng.normal(0, 0.01, 64) for _ in range(200)))]
            rows += [(1000 * g + 500 * side + i, v.tolist()) for i, v in enumerate(group)]
    unit = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    link = unit @ unit.T >= 0.9
    for g in range(8):
        left, right = ((ids // 500) == 2 * g), ((ids // 500) == 2 * g + 1)
        assert link[left][:, right].sum() == 1
    got = {r.vec_id: r for r in nn_descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i].component_id == i // 1000 * 1000 for i in got)
    assert all(got[i].n_links == n - 1 for i, n in zip(ids.tolist(), link.sum(axis=1).tolist(), strict=True))


def test_recordings_align():
    time = np.arange(2000) / chroma.RATE
    song = lambda seed: np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (n / 12) * time) for n in np.random.default_rng(seed).integers(-12, 12, 20)])
    noisy = lambda x: (128 + 50 * x + np.random.default_rng(9).normal(0, 2, len(x))).clip(0, 255).astype(np.uint8)
    a, b, c = (chroma.fingerprint(chroma.frames(noisy(x))) for x in (song(1), song(1)[640:], song(2)))
    assert chroma.align(a, b)[0] == 10 and chroma.align(a, b)[1] < 0.1
    assert chroma.align(a, c)[1] > 0.2


def test_matched_recordings_equal_brute_force(spark):
    """Noisy copies and excerpts of 40 % against every offset of every pair, for every id that 50 divides."""
    rng, rows = np.random.default_rng(4), []
    time = np.arange(2000) / chroma.RATE
    for song in range(4):
        sound = np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (n / 12) * time) for n in rng.integers(-12, 12, 8)])
        for k, noise in enumerate((1, 4, 10, 20, 30)):
            rows.append((50 * song + k, (64 + 30 * sound + rng.normal(0, 0.6 * noise, len(sound))).clip(0, 127).astype(np.uint8).tobytes().decode()))
        begin = int(rng.integers(0, 9000))
        rows.append((50 * song + 9, rows[-5][1][begin : begin + 6400]))
    rows += [(i, rng.integers(0, 128, int(rng.integers(1400, 4000)), np.uint8).tobytes().decode()) for i in range(200, 260, 10)] + [(300, None), (None, "x" * 3000)]
    items = {i: chroma.fingerprint(chroma.frames(np.frombuffer((b or "").encode(), np.uint8))) for i, b in rows}
    got = {r.page_id: r for r in chroma.matched(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    hits, excerpts = 0, 0
    for q in (0, 50, 100, 150, 200, 250, 300):
        found = [(error, i, off) for i in items if i not in (q, None) and len(items[q]) and len(items[i]) for off, error in [chroma.align(items[q], items[i])] if error <= chroma.MOST_ERROR]
        assert got[q].n_matches == len(found)
        if found:
            assert (got[q].best_error, got[q].best_id, got[q].best_offset) == (pytest.approx(min(found)[0]), *min(found)[1:])
        hits, excerpts = hits + len(found), excerpts + sum(i == q + 9 for _, i, _ in found)
    assert hits >= 12 and excerpts == 4


def recordings(parts):
    return chroma.Recordings(np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64))


def test_recordings_that_cannot_overlap_enough_are_not_compared(monkeypatch):
    """10 integers beside 100 lack 10 of the 20 that an overlap needs at least; 10 beside 16 have one offset's charge to spare."""
    rng = np.random.default_rng(6)
    part = lambda n: rng.integers(0, 1 << 32, n, np.uint32)
    short, long, near = part(10), part(100), part(16)
    near[3:13] = short
    assert chroma.align(short, near)[1] <= chroma.MOST_ERROR < chroma.align(short, long)[1]
    assert [x.tolist() for x in chroma.matches(recordings([short]), recordings([near, long]), chroma.MOST_ERROR)[:3]] == [[0], [0], [-3]]

    def met(*_):
        raise AssertionError("compared")

    monkeypatch.setattr(chroma.Recordings, "pairs", met)
    for x, y in (([short], [long]), ([long], [short])):
        assert not len(chroma.matches(recordings(x), recordings(y), chroma.MOST_ERROR)[0])


def test_matches_of_all_lengths_equal_brute_force(monkeypatch):
    """Blocks that end early and those that do not, few and many recordings of one length, sums beyond 16 bits."""
    rng = np.random.default_rng(7)
    part = lambda n: rng.integers(0, 1 << 32, n, np.uint32)

    def noisy(items, error):
        bits = rng.random((len(items), 32)) < error
        return items ^ (bits << np.arange(32, dtype=np.uint32)).sum(axis=1).astype(np.uint32)

    songs = [part(n) for n in (1, 2, 7, 12, 12, 15, 16, 21, 31, 32, 40, 65, 97, 130, 301)]
    x = [*songs, *(part(12) for _ in range(60)), part(4100), np.zeros(90, np.uint32)]
    y = [noisy(s, e) for s in (*songs, x[-2]) for e in (0.02, 0.1)] + [noisy(s[len(s) // 5 :], 0.05) for s in songs if len(s) > 20]
    y += [np.concatenate([part(5), s, part(40)]) for s in songs if len(s) > 60] + [noisy(np.zeros(n, np.uint32), 0.05) for n in range(70, 130, 4)] + [x[30], part(33), part(400)]
    expected = [(a, b, *chroma.align(p, q)) for a, p in enumerate(x) for b, q in enumerate(y)]
    expected = [(a, b, off, pytest.approx(error)) for a, b, off, error in expected if error <= chroma.MOST_ERROR]
    assert len(expected) >= 50
    for few in (chroma.FEW, 1, 1 << 40):
        monkeypatch.setattr(chroma, "FEW", few)
        got = list(zip(*(v.tolist() for v in chroma.matches(recordings(x), recordings(y), chroma.MOST_ERROR)), strict=True))
        assert got == expected


def test_binary_recordings_are_read_byte_by_byte(spark):
    """Samples of 128 and more in a binary column, null, short and repeated recordings, no rows, a clashing column."""
    rng = np.random.default_rng(3)
    sound = (128 + 100 * np.sin(np.arange(4000) / 9)).astype(np.uint8)
    rows = [(1, bytes(sound), 1), (50, bytes(sound), 1), (50, bytes(sound), 1), (2, bytes([200] * 1000), 1), (3, None, 1), (4, b"", 1), (None, bytes(rng.integers(0, 256, 3000, np.uint8)), 1)]
    audio = spark.createDataFrame(rows, "rec long, sound binary, items int")
    got = [r for r in chroma.matched(audio, "rec", "sound").collect()]
    assert sorted((r.n_frames, r.n_items) for r in got) == sorted([((n - 512) // 64 + 1, max(0, (n - 512) // 64 - 14)) if n >= 512 else (0, 0) for n in (4000, 4000, 4000, 1000, 0, 0, 3000)])
    assert [(r.n_matches, r.best_id) for r in got if r.rec == 50] == [(2, None)] * 2
    assert chroma.matched(audio.limit(0), "rec", "sound").count() == 0


def test_classifiers_without_labels_and_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x")], "doc_id long, text string").withColumn("score", F.lit(7))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ones = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    for module, score in ((toxicity, toxicity.toxicity), (boosted, boosted.quality)):
        for labels, expected in ((none, 0.5), (ones, 0.999)):
            got = score(docs, module.train(docs, labels)).collect()
            assert len(got) == 5 and all(abs(r.score - expected) < 1e-6 for r in got)
            assert [r.held_out for r in got if r.doc_id is None] == [False]
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
        assert score(docs.limit(0), module.train(docs.limit(0), none)).count() == 0


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.9), (boosted, "quality", 0.97)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    scored = (module.toxicity if module is toxicity else module.quality)(docs, model)
    hit = scored.where("held_out").join(labels, "doc_id").selectExpr(f"avg(cast(predicted = {label} as int)) as a").first().a
    assert hit >= least
