import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from batchwright.llm import decontamination, toxicity
from batchwright.llm.bpe import read_ranks

from test_decontamination import ITEM, split
from test_line_dedup import brute as brute_lines
from test_minhash_dedup import brute as brute_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def encoder():
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as file:
        ranks = read_ranks(file.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_each_stage_on_its_own_input(spark, sf):
    """Every stage against brute force over what the stage before it kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]
    kept, frames = {}, {}
    for name in names:
        docs = corpus_pipeline.materialize(stages[name](spark, docs, sf), f"test-{name}")
        frames[name] = docs
        if name != "byte_bpe":
            assert docs.columns == COLUMNS
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = toxicity.toxicity_report(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()
    assert set(kept["toxicity"]) == {r.doc_id for r in scores if not r.predicted}
    assert set(kept["line_dedup"]) == set(kept["toxicity"])
    lines = {r[0]: r[3] for r in brute_lines(list(kept["toxicity"].items()))}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept["line_dedup"].items()} == lines
    groups = brute_groups(list(kept["line_dedup"].items()), 80)
    assert set(kept["near_duplicates"]) == {r[0] for r in groups if r[3]}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in map(split, items) for i in range(max(1, len(w) - 9)) if w}
    for doc_id, text in kept["near_duplicates"].items():
        words = split(text)
        clean = not any(tuple(words[i : i + 10]) in windows for i in range(len(words) - 9))
        assert not clean or kept["decontamination"][doc_id] == text
    for text in kept["decontamination"].values():
        words = split(text)
        assert not any(tuple(words[i : i + 10]) in windows for i in range(len(words) - 9))
    tokens = {r.doc_id: r.token_ids for r in frames["byte_bpe"].collect()}
    theirs = encoder()
    assert tokens == {i: theirs.encode_ordinary(t) for i, t in kept["decontamination"].items()}
    assert sorted(tuple(r)[:2] for r in corpus_pipeline.run(spark, sf).collect()) == sorted((i, len(t)) for i, t in tokens.items())


def test_stages_with_odd_rows(spark, tmp_path):
    rows = [(1, None, None, "s", None), (2, "", "en", None, 0), (None, "no id at all", "en", "s", 12), (3, "w " * 30000, "en", "s", 60000),
            (4, "same text here", "en", "s", 14), (4, "same text here", "en", "s", 14), (5, f"Intro. {ITEM}! Outro and some more words to keep it well below the limit",
             "en", "s", 1), (6, ITEM, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        assert docs.columns == COLUMNS
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert (5, "Intro. ! Outro and some more words to keep it well below the limit") in texts
    assert not any(i == 6 for i, _ in texts)
    assert {(1, None), (2, ""), (None, "no id at all")} <= texts
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_passages_of_several_blocks_go(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)
    other = " ".join(f"item{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a b c d e f g h i j k l m n {ITEM} o p q r s t u v {other} w x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, other)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "item_blocks", lambda b: [[("1", ITEM)], [("2", other)]])
    got = decontamination.decontaminate(docs, items).collect()
    assert got[0].text.split() == list("abcdefghijklmn") + list("opqrstuv") + list("wxyz")


def test_near_copies_of_82_percent_are_one(spark):
    words = [f"w{i}" for i in range(300)]
    other = words[:-28] + [f"v{i}" for i in range(28)]  # 268 of 324 shingles in common
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 0), (2, " ".join(other), "en", "s", 0), (3, " ".join(words[:40]), "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]
