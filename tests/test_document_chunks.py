"""The kernel's queries over documents of several chunks, against the texts themselves."""

import hashlib
import random

from bytequarry.plans import catalog


def test_kernel_queries_cover_documents(spark, tmp_path):
    rng = random.Random(5)
    block = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=1500))
    texts = {1: block * 4 + "é" * 100, 2: "short", 3: "".join(rng.choices("abcd", k=4097))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, c): t.encode()[c * 4096 : (c + 1) * 4096] for i, t in texts.items() for c in range(-(-len(t.encode()) // 4096))}
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.chunk): r.raw_sha256 for r in run("kernel_round_trip")} == {k: hashlib.sha256(v).hexdigest() for k, v in want.items()}
    matches, covered = [], dict.fromkeys(want, 0)
    for r in run("documents_lz_tokens"):
        raw = want[r.doc_id, r.chunk]
        covered[r.doc_id, r.chunk] += r.len
        if r.dist:
            matches.append((r.len, r.dist))
            assert all(raw[i] == raw[i - r.dist] for i in range(r["at"], r["at"] + r.len))
    assert covered == {k: len(v) for k, v in want.items()} and len(want) == 5
    assert max(n for n, _ in matches) > 394 and max(d for _, d in matches) > 394
