from __future__ import annotations

import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import secrets
from tests.llm.test_dedup import plain_components
from tests.llm.test_text_rules import plain_counts, plain_line_dedup, plain_spans


def plain_pipeline(rows):
    """doc_id -> text after all stages but packing; no host here fails in more than half of its documents."""
    kept = []
    for i, t in rows:
        n, _, _, _, again = plain_counts(t)
        if not (n < 10 or 100 * again > 20 * n):
            kept.append((i, t))
    cleaned = [(i, t) for i, (t, _, gone) in plain_line_dedup(kept).items() if not gone or t.split()]
    home = plain_components(cleaned, 5)
    out = {}
    for i, t in cleaned:
        if home[i] != i:
            continue
        spans: list[list[int]] = []
        for a, _, z in plain_spans(t):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], z)
            else:
                spans.append([a, z])
        edges = [0, *(x for s in spans for x in s), len(t)]
        out[i] = "[SECRET]".join(t[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
    return out


def documents():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", " ", "\n"]) for _ in range(n)).strip()
    shared = "\n".join(text(6).replace("\n", " ") for _ in range(4))
    rows = [text(r.randrange(12, 400)) for _ in range(30)]
    rows += [rows[0], rows[1] + " more", None, "too short", "again and again " * 30, shared + "\n" + text(40), text(30) + "\n" + shared, text(20) + ' password="hunter2hunter2" ' + text(20), text(15) + " Zx81kQpLm0aR7vTy2WcN9dEf " + text(9), text(3000)]
    line = text(200).replace("\n", " ")
    rows += [line, line + " end"]
    return list(enumerate(rows))


def test_pipeline_against_a_plain_version(spark, docs_of, tmp_path, word_bpe):
    rows = documents()
    docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library, expected = Tokenizer.from_file(word_bpe), plain_pipeline(rows)
    assert {r["doc_id"] for r in out} == expected.keys() and len(expected) == len(rows) - 5
    assert any("[SECRET]" in t for t in expected.values())
    for i, t in expected.items():
        parts = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        ids = [x for r in parts for x in np.frombuffer(bytes(r["ids"]), "<u4").tolist()]
        assert ids == [*library.encode(t, add_special_tokens=False).ids, 1], i


def test_stages_keep_the_columns_of_documents(spark, docs_of, tmp_path):
    df = docs_of(documents())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns, name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None and secrets.KINDS[-1] == "entropy"
