"""The pipeline against a brute-force version of each stage, one after another."""

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent.parent))

import corpus_pipeline
from test_operators import _near_duplicates_by_brute_force

from clausewise.llm import pii, toxicity

SF = "/root/testdata/sf0.001"


def _without_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for text, b in zip(texts, data, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept, at = [], 0
        for c in text or "":
            size = len(c.encode())
            if not gone[at : at + size].all():
                kept.append(c)
            at += size
        out.append(None if text is None else "".join(kept))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    random.seed(4)
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()[:150]
    passage = " ".join(random.choice(["river", "stone", "lamp", "é", "cloud"]) + str(random.randint(0, 99)) for _ in range(60))
    base = docs[3]
    more = [(base["doc_id"], base["text"]), (9001, base["text"]), (9002, base["text"] + " one more word"), (9003, f"start {passage} end"), (9004, f"other {passage} close"), (9005, "write to ann at host dot dev or 10.0.0.1"), (9006, None), (9006, None), (9007, ""), (None, "no id here")]
    for doc_id, text in more:
        docs.append({**base, "doc_id": doc_id, "text": text, "n_chars": len(text or "")})
    schema = pq.read_schema(f"{SF}/documents.parquet")
    pq.write_table(pa.Table.from_pylist(docs, schema=schema), tmp_path / "documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), tmp_path / "labels.parquet")
    stages, got, held = dict(corpus_pipeline.STAGES), {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, str(tmp_path))
        if name != "packing":
            assert out.columns == held.columns and out.dtypes == held.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = held.toPandas().to_dict("records") if name == "packing" else [r.asDict() for r in held.collect()]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["text"] is None)

    machine = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = machine.score(pa.array([d["text"] or "" for d in docs], pa.string()))
    expected = [d for d, s in zip(docs, score, strict=True) if s < 0.5]
    assert sorted(got["toxicity"], key=key) == sorted(expected, key=key)

    rows = sorted(expected, key=key)
    _, group = _near_duplicates_by_brute_force([(r["doc_id"], r["text"]) for r in rows])
    worded = [bool((r["text"] or "").split()) for r in rows]
    members = defaultdict(list)
    for i, g in enumerate(group):
        if worded[i]:
            members[g].append(i)
    kept = [m[0] for m in members.values()]
    found = sorted(got["near_duplicates"], key=key)
    assert len(found) == len(kept) + worded.count(False)
    # of each group one row with its least id
    assert Counter((r["doc_id"], bool((r["text"] or "").split())) for r in found) == Counter([(rows[i]["doc_id"], True) for i in kept] + [(r["doc_id"], False) for r, w in zip(rows, worded, strict=True) if not w])

    texts = _without_repeats([r["text"] for r in found])
    expected = [{**r, "text": t, "n_chars": None if t is None else len(t)} for r, t in zip(found, texts, strict=True)]
    assert sorted(got["suffix_dedup"], key=key) == sorted(expected, key=key)

    expected = [{**r, "text": t, "n_chars": None if t is None else len(t)} for r in expected for t in [None if r["text"] is None else pii.redact(r["text"], pii.find(r["text"])[1])]]
    assert sorted(got["personal_data"], key=key) == sorted(expected, key=key)
    assert "write to [EMAIL] or [IP]" in [r["text"] for r in expected]

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in expected)
    lengths, filled = defaultdict(int), defaultdict(int)
    assert sum(r["length"] for r in got["packing"]) == sum(n * c for n, c in tokens.items())
    for r in sorted(got["packing"], key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
        lengths[r["length"]] += 1
    assert max(filled.values()) <= 1024 and len(filled) <= 1.02 * sum(filled.values()) / 1024 + 1

    whole = corpus_pipeline.run(spark, str(tmp_path))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole.select(columns).collect())) == sorted(map(str, held.select(columns).collect()))
    assert set(stages) == {"toxicity", "near_duplicates", "suffix_dedup", "personal_data", "packing"}
