import zlib

import corpus_pipeline
from spokenspark.llm import decontamination, simhash
from spokenspark.llm.packing import default_ranks, subwords
from test_operators import benchmark_windows

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kept = [r for r in rows if r.text and any(c.isalpha() for c in r.text)]
    fp = {r.doc_id: simhash.simhash(r.text, 5) % (1 << 64) for r in kept}
    shingles = {r.doc_id: {tuple(w[i : i + 5]) for w in [r.text.encode().lower().split()] for i in range(max(1, len(w) - 4))} for r in kept}
    alike = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2 or len(x := shingles[a] & shingles[b]) and len(x) >= 0.8 * len(shingles[a] | shingles[b])
    near = {a: [b for b in fp if alike(a, b)] for a in fp}
    least = {i: i for i in fp}
    for _ in range(8):
        for a in fp:
            least[a] = min(least[b] for b in near[a])
    kept = [r for r in kept if least[r.doc_id] == r.doc_id]
    wins = benchmark_windows([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()], 10)
    sizes = {len(w) for w in wins}
    clean = lambda t: not any(tuple(w[i : i + n]) in wins for w in [decontamination.words(t)] for n in sizes for i in range(len(w) - n + 1))
    kept = [r for r in kept if clean(r.text)]
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in kept}
    bpe = subwords(default_ranks())
    same = [r for r in kept if "token =" not in r.text and "AKIA" not in r.text]
    crc = {r.doc_id: r.ids_crc32 for r in out if r.piece == 0 and r.length < 2048}
    whole = {r.doc_id: zlib.crc32(bpe.ids(r.text) + bytes(4)) for r in same if len(bpe.ids(r.text)) // 4 + 1 < 2048}
    assert whole and all(crc[i] == c for i, c in whole.items() if i in crc)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
