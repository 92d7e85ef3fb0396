import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import encoding, secrets, shared

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, spans string, component string, ids string, length int"
ITEM = "What is the tallest peak of the eastern range beyond the river? It is mount alderan in the north."


def documents() -> list[tuple]:
    rnd = random.Random(41)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = say(60)
    near = base.split()
    near[30] = "changed"
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: say(80), 5: f"{say(30)} {ITEM} {say(30)}", 6: f"{say(20)} user: alice pwd: hunter2x token=abcdefghij {say(20)}",
        7: None, 8: "", 9: "too short", 10: "one two three four five " * 20, 11: say(9000), 12: f"{say(40)} {'Qw7' * 90} {say(20)}",
    }
    rows = [(d, t) for d, t in texts.items()] + [(4, texts[4]), (4, texts[4]), (None, say(50)), (None, None)]
    return [(d, t, None, "s", None if t is None else len(t), "k", "w", "s", "c", "i", 3) for d, t in rows]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(documents(), DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def plain_stages() -> list[list[tuple]]:
    """(doc_id, text) after each of the first four stages."""
    rows = [(d, t) for d, t, *_ in documents() if not brute.statistics(t)[-1]]
    out = [rows]
    groups = brute.components({d: t for d, t in rows if d is not None}, 5)
    seen, left = set(), []
    for d, t in rows:
        if d is None or groups[d] == d and d not in seen:
            left.append((d, t))
            seen.add(d)
    out.append(left)
    out.append([(d, t) for d, t in left if ITEM not in (t or "")])

    def masked(t: str) -> str:
        hidden = [s for s in brute.linked_secrets(t, secrets.KINDS, secrets.SCOPE) if secrets.KINDS[s[1]].role != "endpoint"]
        gone = [any(a <= i < b for a, _, b in hidden) for i in range(len(t))]
        return "".join(c if not g else "[SECRET]" if i == 0 or not gone[i - 1] else "" for i, (c, g) in enumerate(zip(t, gone, strict=True)))

    return [*out, [(d, masked(t)) for d, t in out[-1]]]


def test_each_stage_against_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (_, stage), want in zip(corpus_pipeline.STAGES, plain_stages(), strict=False):
        columns = docs.columns
        docs = shared.stored(stage(spark, docs, folder))
        assert docs.columns == columns
        got = docs.collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(want)
        assert all(r["n_chars"] == len(r["text"]) and r["kept"] == "k" and r["length"] == 3 for r in got)


def test_the_whole_chain(spark, folder):
    since = shared.made()
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert shared.made() == since + 1  # what stages stored on their way is gone
    encoder = encoding.encoder(encoding.default_path())
    want = Counter()
    for d, t in plain_stages()[-1]:
        ids = np.frombuffer(encoder.ids(t) + (0).to_bytes(4, "little"), "<u4")
        want[d] += len(ids)
        own = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == d)
        assert [n for s, n, c in own if zlib.crc32(ids[s : s + n].tobytes()) == c] == [n for _, n, _ in own] and own[0][0] == 0
    assert Counter({d: sum(p["length"] for p in pieces if p["doc_id"] == d) for d in want}) == want and {p["doc_id"] for p in pieces} == set(want)


def test_no_documents(spark, folder, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_the_sizes_of_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "decontamination", "secret scan", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
