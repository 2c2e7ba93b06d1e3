"""The whole pipeline against a brute-force version of its stages."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

pytest.importorskip("vellum.llm")

from tests.llm.test_llm import brute_lines, jaccard, multiset  # noqa: E402
from vellum.llm import bpe, toxicity  # noqa: E402
from vellum.llm.queries import WFQ_SQL  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def one_of_each_class(rows):
    """(id, text) of the least id of each class of texts that are alike to 0.8 or more; ids are unique."""
    sets = [multiset(text) for _, text in rows]
    sizes = [sum(s.values()) for s in sets]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]) and part[i] != part[j] and jaccard(sets[i], sets[j]) >= 0.8:
                part = [part[j] if p == part[i] else p for p in part]
    least = {}
    for (i, text), p in zip(rows, part, strict=True):
        least[p] = min(least.get(p, (i, text)), (i, text))
    return sorted(least.values())


def mixed(rows, source):
    """Texts taken by the mix's SQL: whole ones as they are, one taken in part as its first words; a row each time."""
    documents = pd.DataFrame([(i, source[i], text) for i, text in rows], columns=["doc_id", "source", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    texts, out = dict(rows), []
    for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({WFQ_SQL})").fetchall():
        out += [(i, texts[i])] * (taken // size if size else 0)
        if size and taken % size:
            out.append((i, " ".join(WORD.findall(texts[i])[: taken % size])))
    return out


def test_pipeline_equals_brute_force(spark, sf):
    import corpus_pipeline

    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    # The classifier's own verdicts: its quality is held against labels elsewhere.
    toxic = {r.doc_id for r in toxicity.scored(documents, labels).where("predicted = 1").collect()}
    rows = documents.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and toxic
    lines = brute_lines([(r.doc_id, r.text) for r in rows if r.doc_id not in toxic])
    kept = one_of_each_class([(i, text) for i, _, _, text in lines.elements()])
    assert len(kept) < len(rows) - len(toxic)
    encoder = bpe.encoding(bpe.public_tokenizers.path(bpe.RANKS))
    want = Counter()
    for i, text in mixed(kept, {r.doc_id: r.source for r in rows}):
        ids = np.array(encoder.encode_ordinary(text), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == want
