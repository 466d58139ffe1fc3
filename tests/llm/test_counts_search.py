"""Token counts, whitening and lexical search against the library, a full decomposition and brute force."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from locusframe.llm import lexical, token_counts, whitening

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, n long, score long, terms string, item string, hash string"
_ALPHABET = list("abcdefghijklmnopqrstuvwxyzABCDEFG'  \n\t\r 0123456789.,;:!?-_<|>éüß中文字😀́  ​　\x1c\x85½²٣") + ["<|endoftext|>", "'s", "'ll", " the", " of", "  ", "ing"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_counts_are_the_library_s(tokenizer):
    rng = random.Random(3)
    count = token_counts.WholeTokens(P.path("byte_bpe_50k.json"), remembered=50)
    for _ in range(3000):
        text = "".join(rng.choices(_ALPHABET, k=rng.randrange(60)))
        assert count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_proof_is_used(tokenizer):
    count = token_counts.WholeTokens(P.path("byte_bpe_50k.json"))
    assert len(count.proven) > 49_000
    assert all(len(tokenizer.encode(t, add_special_tokens=False).ids) == 1 for t in random.Random(1).sample(sorted(count.proven.values()), 3000))
    assert count(" the house, (and) 1999") == 7 and count.merged == 0
    assert count(" Xqzvbrt") > 1 and count.merged == 1


def test_proof_refuses_other_tokenizers(tmp_path):
    with pytest.raises(ValueError):
        token_counts.WholeTokens(P.path("word_bpe_49k.json"))


def test_token_count_rows(spark, tokenizer):
    texts = [None, "", " ", "one", "one", "a" * 200_000, " word" * 1024, " word" * 1025, "x <|endoftext|> y", "中文字 " * 40_000]
    data = [(i if i else None, t, 1, 2, "x", "y", "z") for i, t in enumerate(texts)]
    got = token_counts.token_counts(spark.createDataFrame(data, CLASHING), P.path("byte_bpe_50k.json")).collect()
    want = [(i if i else None, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert sorted([tuple(r)[:3] for r in got], key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(spark.createDataFrame([], CLASHING), P.path("byte_bpe_50k.json")).count() == 0


def test_token_counts_of_the_tables(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.op11_token_counts(spark, SF).collect()}
    assert got == {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}


def _check_whitening(rows, data, most=16):
    """``rows`` of ``whiten`` against a full decomposition of ``data`` (id, vector)."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in data], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    _, sizes, components = np.linalg.svd((n * fit - sums) / n, full_matrices=False)
    e = sizes**2 / n
    k = min(most, int((sizes > sizes[0] * 1e-12).sum()))
    assert sorted((str(r.vec_id), r.component) for r in rows) == sorted((str(i), c + 1) for i, _ in data for c in range(k))
    assert {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-6
    for r in rows:
        assert math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9)
    far = {str(i): sum(int(d) ** 2 for d in n * x[a] - sums) for a, (i, _) in enumerate(data)}
    assert all(far[str(r.vec_id)] == r.deviation for r in rows)
    want = np.abs(((n * x - sums) / n) @ components[:k].T / np.sqrt(e[:k]))
    at = {str(i): a for a, (i, _) in enumerate(data)}
    assert max(abs(abs(r.whitened) - want[at[str(r.vec_id)], r.component - 1]) for r in rows) < 1e-6


def test_whitening(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((200, 20)) * np.linspace(3, 0.5, 20)
    data = [(i, v.tolist()) for i, v in enumerate(base)] + [(300 + i, base[i % 3].tolist()) for i in range(40)]
    bad = [(900, None), (901, []), (902, [None] * 20), (903, [float("nan")] * 20), (904, [float("inf")] + [0.0] * 19), (905, [1e300] * 20)]
    table = spark.createDataFrame([(k, v, "t", 1) for k, v in [*data, (None, base[5].tolist()), *bad]], "vec_id long, embedding array<double>, x string, component int").repartition(5)
    rows = whitening.whiten(table).collect()
    _check_whitening(rows, [*data, (None, base[5].tolist())])
    signs = {}
    for r in rows:  # rows of equal vectors are equal but for the last bits of block products
        signs.setdefault((r.deviation, r.component), set()).add(r.whitened)
    assert all(max(x) - min(x) < 1e-12 for x in signs.values())


def test_whitening_of_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-50, 50, (60, 4)) / 4
    data = [(i, [*v, v[0], 1.0]) for i, v in enumerate(base.tolist())]
    _check_whitening(whitening.whiten(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect(), data)
    few = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 5.0]), (3, [2.0, 2.0, 5.0])]
    _check_whitening(whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect(), few)


def test_whitening_without_variance_or_of_several_lengths(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    rng = np.random.default_rng(6)
    short, long = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((30, 3)) * 9)], [(100 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((30, 5)) * 9)]
    rows = whitening.whiten(spark.createDataFrame(short + long, schema)).collect()
    _check_whitening([r for r in rows if r.vec_id < 100], short)
    _check_whitening([r for r in rows if r.vec_id >= 100], long)


def test_cholesky_passes_undo_a_squared_condition():
    rng = np.random.default_rng(7)
    a = (rng.standard_normal((500, 20)) * np.logspace(0, -10, 20)) @ np.linalg.qr(rng.standard_normal((20, 20)))[0]

    def gram(solves):
        q = a
        for r in solves:
            q = whitening.solve(q, r)
        return q.T @ q

    r, trace = whitening.factors(gram, *a.shape)
    want = np.linalg.svd(a)[1]
    assert np.allclose(np.linalg.svd(r)[1][:16], want[:16], rtol=1e-8)
    assert math.isclose(trace, (a**2).sum())
    assert not np.allclose(np.sqrt(np.abs(np.linalg.eigvalsh(a.T @ a)))[::-1][:16], want[:16], rtol=1e-2)  # what one Gram matrix gives


def test_deviations_past_64_bits():
    x = np.array([[2**40, -(2**40)], [0, 0]])
    n = 2**30
    assert (whitening.deviations(x, n, np.array([5, 7])) == np.array([[n * 2**40 - 5, -n * 2**40 - 7], [-5, -7]], dtype=object)).all()


_TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return _TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute_force(docs, items, top=10):
    held = [(k, _terms(t)) for k, t in docs]
    held = [(k, ts) for k, ts in held if ts]
    total, length = len(held), sum(len(ts) for _, ts in held)
    df = Counter(t for _, ts in held for t in set(ts))
    out = []
    for item, text in items:
        found = []
        for k, ts in held:
            m, tf, score = 25 + 75 * len(ts) * total // length, Counter(ts), 0
            for t in _terms(text):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, math.inf if k is None else k))
        out += [(item, n + 1, None if k == math.inf else k, -s) for n, (s, k) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def test_terms_are_the_pattern_s():
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choices([*map(chr, range(128)), "é", "中", "😀", "İ", "K", "\x85", " "], k=40))
        assert [t.decode() for t in lexical.terms(text.encode())] == _terms(text)


def test_lexical_search(spark):
    rng = random.Random(8)
    words = [a + b for a in "abcdeéA" for b in "xyz0"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + [(7, docs[9][1]), (None, docs[5][1]), (None, "ax ay"), (2000, None), (2001, ""), (2002, " .,"), (2003, " ".join(rng.choices(words, k=60_000)))]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(30)]
    items += [(50, docs[5][1]), (51, "not there"), (52, None), (53, ""), (54, "ax"), (55, "AX, ax ax"), (None, "by"), (56, " ".join(words * 300))]
    table = spark.createDataFrame([(k, t, 1, 2, "x", "y", "z") for k, t in docs], CLASHING).repartition(7)
    asked = spark.createDataFrame([(k, t, 3) for k, t in items], "item_id long, text string, rank int")
    want = _brute_force(docs, items)
    assert sorted(map(tuple, lexical.search(table, asked).collect()), key=str) == want
    sliced = lexical.search(table, asked, most_terms=40, most_items=3)
    assert sorted(map(tuple, sliced.collect()), key=str) == want
    assert sorted(map(tuple, lexical.search(table, asked, top=200).collect()), key=str) == _brute_force(docs, items, 200)


def test_lexical_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [(1, 1, 1)]


def test_bags_form_classes(spark):
    docs = spark.createDataFrame([(i, "ax by by" if i % 2 else f"by ax by z{i}") for i in range(100)], "doc_id long, text string")
    bags = lexical.bags(docs, [b"ax", b"by"])
    found = lexical.classes(bags, 100, 350, 10).orderBy("m").collect()
    assert [(list(r.terms), list(r.freqs), r.m) for r in found] == [([0, 1], [1, 2], 25 + 75 * 300 // 350), ([0, 1], [1, 2], 25 + 75 * 400 // 350)]
    assert list(found[0].members) == list(range(1, 20, 2)) and list(found[1].members) == list(range(0, 20, 2))


def test_lexical_search_sql(spark):
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(map(tuple, lexical.op13_lexical_search(spark, SF).collect())) == sorted(duckdb.sql(lexical.ORACLE_SQL).fetchall())
