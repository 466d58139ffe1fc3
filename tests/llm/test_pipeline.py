"""Stages of the corpus pipeline: columns, order, empty input and whole results."""

import base64
import hashlib
import random
import re

import corpus_pipeline
import pytest
from locusframe.llm._common import materialise

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [0, 200])
def test_stages(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs if rows else docs.limit(0)
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "source_mix", "byte_bpe"]
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
        counts.append(docs.count())
        assert name == "byte_bpe" or docs.columns == columns
    if rows:
        assert counts[0] == 200 and counts[1] > 150 and counts[2] > 150 and counts[3] > counts[2] and counts[4] == counts[3]
    else:
        assert counts == [0] * 5


def test_clean_documents_stay(spark):
    """Rows without doc_id, mixed languages, blank texts and unlabelled corpora are not lost on the way."""
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    en, de, fr = "the house and the garden with the old tree " * 9, "das haus und der garten mit dem alten baum " * 9, "la maison et le jardin avec le vieil arbre " * 9
    data = [(1, en, "en", "a", 0), (2, de, "de", "a", 0), (3, fr, "fr", "a", 0), (None, "a text without any id but with words of its own", None, "b", 0)]
    data += [(4, en[:86] + de[:86] + fr[:86], None, "b", 0), (5, en, None, "b", 0), (6, "12 34", None, "b", 0), (7, None, None, "b", 0)]
    docs = spark.createDataFrame(data, schema)

    def ids(df):
        return sorted(r.doc_id or 0 for r in df.collect())

    assert ids(corpus_pipeline.identify_language(spark, docs, SF)) == [0, 1, 2, 3, 4, 5]
    unlabelled = docs.selectExpr("doc_id", "text", "string(null) lang", "source", "n_chars")
    assert ids(corpus_pipeline.identify_language(spark, unlabelled, SF)) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert ids(corpus_pipeline.drop_near_duplicates(spark, docs, SF)) == [0, 1, 2, 3, 4, 6, 7]
    lines = spark.createDataFrame([(1, "one two", None, "a", 0), (2, "one two", None, "a", 0), (3, " ", None, "a", 0), (4, None, None, "a", 0)], schema)
    assert ids(corpus_pipeline.drop_repeated_lines(spark, lines, SF)) == [1, 3, 4]


def _brute_force(data):
    """The pipeline's rows of small documents ``doc_id, text, source`` in plain Python, but for the language stage: no letters, no document."""
    docs = {k: (t, s) for k, t, s in data if any(c.isalpha() for c in t or "")}
    seen, after = [], {}
    for k in sorted(docs):
        lines = []
        for line in docs[k][0].split("\n"):
            words = set(re.split(r"[\x20\x09-\x0D]+", line.lower())) - {""}
            if not words or all(5 * len(words & x) < 4 * len(words | x) for x in seen):
                lines.append(line)
            seen += [words] if words else []
        if len(lines) == docs[k][0].count("\n") + 1 or any(line.split() for line in lines):
            after[k] = "\n".join(lines)
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for k, t in after.items()}
    group = {k: k for k in after}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    kept = [k for k in after if group[k] == k]
    size = {k: len(after[k].split()) for k in kept}
    sources = sorted({docs[k][1] for k in kept})
    total = {s: sum(size[k] for k in kept if docs[k][1] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_ = {}, list(sources)
    while open_:
        left = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        target |= {s: 2.0 * total[s] for s in over} if over else share
        open_ = [s for s in open_ if s not in over] if over else []
    out = []
    for s in sources:
        words = int(target[s] + 0.5)
        whole, rest = divmod(words, total[s])
        for k in sorted((k for k in kept if docs[k][1] == s), key=lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest()):
            part = max(0, min(size[k], rest))
            rest -= size[k]
            out += [(k, after[k])] * (whole + (part == size[k])) + ([(k, " ".join(after[k].split()[:part]))] if 0 < part < size[k] else [])
    return sorted(out)


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    base, passage = prose(60), prose(12)
    data = [(1, base, "a"), (2, base + " end", "a"), (3, passage + "\n" + prose(20), "b"), (4, prose(9) + "\n" + passage, "c"), (5, "12 34", "a"), (6, None, "b"), (7, passage, "b")]
    data += [(10 + k, prose(rnd.randrange(1, 50)) + ("\n" + passage.upper() if k % 3 == 0 else ""), "abc"[k % 3]) for k in range(20)]
    rows = [(k, t, "en", s, len(t or "")) for k, t, s in data]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(k, reference.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in _brute_force(data)]
    got = [(r.doc_id, list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_stages_with_awkward_rows(spark):
    """Null texts and ids, repeated rows and columns named like the stages' own go through every stage."""
    names = "_tid _id n_lines n_removed _copy _score row copy words".split()
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    rows = [(3, "some words of a text", None, 0), (3, "some words of a text", None, 0), (None, "other words here", "s", 0), (4, None, "s", 0), (5, "", "s", 0)]
    docs = spark.createDataFrame([(k, t, "en", s, n, *names) for k, t, s, n in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        assert docs.count() > 1 and all(r[n] == n for r in docs.collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
