"""The corpus operators against brute force, round trips and held-out accuracy, with awkward rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from locusframe.llm import byte_bpe, components, language, lines, minhash, mixing, neighbours, registry, segments, sharding, simhash, substrings, wavelet
from locusframe.llm._common import materialise, tracked

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tid string, key string"
random.seed(5)
_WORDS = ["".join(random.choices("abcdefghi", k=random.randrange(1, 7))) for _ in range(60)]


def _prose(n):
    return " ".join(random.choices(_WORDS, k=n))


_BASE = _prose(60)
ROWS = [
    (1, _BASE), (2, _BASE), (3, _BASE.replace("a", "A", 5)), (4, " ".join(_BASE.split()[:-2]) + " zz yy"),
    (5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "one"), (10, "é  naïve   x\x1cy don't 12½ 中文 😀"),
    (11, "ab" * 3000), (12, _prose(3000)), (13, "one two three\nfour five\nOne  two three\n\nfour five six"),
] + [(20 + i, _prose(random.randrange(1, 80)) + "\n" + _BASE[:150] * (i % 2)) for i in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en" if k % 3 else None, random.choice(["a", "b", None]), 0, "x", "y") for k, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def union_find(nodes, edges):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (7, 3), (None, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == union_find({x for e in real for x in e}, real)


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    data = [(i, (base[i % 40] * (i + 1) + rng.standard_normal(16) * 0.3 * (i % 4)).tolist()) for i in range(300)]
    data += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0]), (905, []), (906, data[0][1])]
    got = rows(neighbours.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")), "vec_id")
    good = [(k, np.array(v)) for k, v in data if k < 300 or k == 906]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    ids = [k for k, _ in good]
    want = union_find([k for k, _ in data], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit), strict=True)])
    assert {k: r.component_id for k, r in got.items()} == want
    assert {k: r.n_links for k, r in got.items()} == {**dict.fromkeys(want, 0), **dict(zip(ids, hit.sum(1).tolist(), strict=True))}
    assert neighbours.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_minhash_of_repeated_ids_and_long_texts(spark):
    """Rows of one doc_id are linked each by its own text; families of long texts are cut by bytes."""
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choices(_WORDS, k=n))
    a, b, long = prose(80), prose(80), prose(150_000)
    rows = [(3, a), (3, b), (8, a + " x"), (9, b + " y"), (1, long), (2, long + " z"), (5, prose(90))]
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, doc long, sig string")).collect())
    sizes = {k: len(minhash.shingles(t)) for k, t in rows}
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (5, 5, True), (8, 3, False), (9, 3, False)]
    assert [r[1] for r in got if r[0] != 3] == [sizes[r[0]] for r in got if r[0] != 3]


def test_near_vectors_of_repeated_ids(spark):
    rows = [(5, [1.0, 0.0, 0.0], "x"), (5, [0.0, 1.0, 0.0], "y"), (7, [0.0, 1.0, 0.01], "z"), (9, [0.0, 0.0, 1.0], "x")]
    got = sorted(tuple(r) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")).collect())
    assert got == [(5, 0, 5, True), (5, 1, 5, True), (7, 1, 5, False), (9, 0, 9, True)]


def test_near_vectors_sql_on_a_table_with_links(spark):
    """The query's SQL against the operator where there are links, repeated and null ids and clashing names."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((60, 12))
    data = [(int(i) % 230, (base[i % 60] + rng.standard_normal(12) * 0.15).tolist()) for i in range(300)]
    data += [(3, data[7][1]), (3, data[7][1]), (None, data[8][1]), (None, None), (500, [0.0] * 12), (501, None), (502, [1.0] * 5), (502, [1.0] * 5)]
    table = spark.createDataFrame([(k, v, 1, 2, "t" * 100_000 if i < 2 else None) for i, (k, v) in enumerate(data)], "vec_id long, embedding array<double>, node long, component long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", data)
    want = con.sql(neighbours.ORACLE_SQL).fetchall()
    assert sum(r[1] for r in want) > 500
    assert sorted(map(tuple, neighbours.near_vectors(table).collect()), key=str) == sorted(want, key=str)


def test_link_counts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MEET", 40)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(13)
    x = rng.standard_normal(8) + rng.standard_normal((150, 8)) * 0.4
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, u.tobytes(), 1 + i % 3) for i, u in enumerate(unit)], "node long, unit binary, copies long")
    groups = spark.createDataFrame([(i, 0) for i in range(150)], "node long, component long")
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    assert {r.node: r.n for r in neighbours.link_counts(nodes, groups, 0.9).collect()} == dict(enumerate((hit @ (1 + np.arange(150) % 3)).tolist()))


def test_near_vectors_in_a_hot_bucket(spark):
    """Small groups in one sign bucket of the whole table, beside a hot group: nearly all of their links are found."""
    rng = np.random.default_rng(8)
    mean = np.full(32, 3.0 / np.sqrt(32))
    base = mean + rng.standard_normal((1500, 32)) * 1.6 / np.sqrt(32)
    near = base + rng.standard_normal((1500, 32)) * 0.55 / np.sqrt(32)
    hot = base[0] * 1.0 + mean + rng.standard_normal((1500, 32)) * 0.02
    x = np.concatenate([base, near, hot])
    got = rows(neighbours.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), threshold=0.97), "vec_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.97
    np.fill_diagonal(hit, False)
    small = [i for i in range(3000) if 0 < hit[i].sum() < 4]
    assert len(small) > 500
    assert sum(got[i].n_links for i in small) >= 0.98 * hit[small].sum()


def test_components_keep_one_table(spark):
    """Rounds free what they wrote: in the shared folder only the last table is added."""
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    held = lambda: {p.parent for p in shared.rglob("part-*")}
    before = held()
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    got = components.connected_components(edges)
    assert {r.component for r in got.collect()} == {0} and got.count() == 41
    assert len(held() - before) == 1


def test_audit_sees_split_components(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((61, 16))
    x = np.concatenate([base[:60], base[:60] + 0.01, base[60] + rng.standard_normal((400, 16)) * 0.01])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, v.tobytes(), 1) for i, v in enumerate(unit)], "node long, unit binary, copies long")
    sample = neighbours.audit_sample(nodes, len(unit))
    hot = [(i, 120) for i in range(120, 520)]
    pairs = [(i + 60 * k, i) for i in range(60) for k in (0, 1)]
    table = lambda r: spark.createDataFrame(r, "node long, component long")
    assert neighbours.audit(nodes, table(hot + pairs), sample, 0.9) == 1
    assert neighbours.audit(nodes, table(hot + pairs[:80]), sample, 0.9) < 0.98


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())


def test_minhash(docs, empty):
    got = rows(minhash.near_duplicates(docs))
    sets = {k: _shingles(t) for k, t in ROWS}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert {k: r.component_id for k, r in got.items()} == union_find(sets, links)
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_near_the_threshold(spark):
    """Hundreds of pairs just over and just under the threshold: all links of the brute force, no other."""
    rnd = random.Random(6)
    data = []
    for k in range(250):
        words = [f"v{rnd.randrange(100_000)}" for _ in range(160)]
        other = list(words)
        for at in rnd.sample(range(10, 150, 10), rnd.choice([3, 4, 4, 5])):
            other[at] = "z" + other[at]
        data += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    sets = {k: _shingles(t) for k, t in data}
    links = [(k, k + 1) for k in range(0, 500, 2) if 100 * len(sets[k] & sets[k + 1]) >= 75 * len(sets[k] | sets[k + 1])]
    assert 50 < len(links) < 250
    got = rows(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")))
    assert {k: r.component_id for k, r in got.items()} == union_find(sets, links)


def test_byte_bpe(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(docs, path, P.PATTERN)
    ids = {k: list(r.ids) for k, r in rows(encoded).items()}
    assert ids == {k: reference.encode_ordinary(t or "") for k, t in ROWS}
    assert {k: bytes(r.data).decode() for k, r in rows(byte_bpe.decode(encoded, path, P.PATTERN)).items()} == {k: t or "" for k, t in ROWS}
    digest = rows(byte_bpe.round_trip(docs, path, P.PATTERN))
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids[k])).encode()).hexdigest() for k, r in digest.items())
    assert byte_bpe.encode(empty, path, P.PATTERN).count() == 0


def test_lines(docs, empty):
    seen, want = [], {}
    for k, t in sorted(ROWS):
        kept = []
        for line in (t or "").split("\n"):
            words = set(re.split(r"[\x20\x09-\x0D]+", line.lower())) - {""}
            if not words or all(100 * len(words & s) < lines.PERCENT * len(words | s) for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        want[k] = None if t is None else "\n".join(kept)
    assert {k: r.text for k, r in rows(lines.without_similar_lines(docs)).items()} == want
    assert lines.without_similar_lines(empty).count() == 0


def _cut(data):
    seen, out = set(), {}
    for k, t in sorted(data):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            gone[p : p + 100] |= (known := b[p : p + 100] in seen)
            if not known:
                seen.add(b[p : p + 100])
        out[k] = (len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("most", [20_000, 2])
def test_substrings(docs, empty, most, monkeypatch):
    monkeypatch.setattr(substrings, "MOST", most)
    got = rows(substrings.without_repeats(docs, digest=True))
    assert {k: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for k, r in got.items()} == _cut(ROWS)
    if most > 2:
        assert substrings.without_repeats(empty).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(3)
    symbols, sizes = rng.integers(0, 2, (300, 12)).astype(np.int16), rng.integers(0, 13, 300)
    group = np.sort(rng.integers(0, 9, 300))
    order, shared = substrings.Suffixes(symbols, sizes).sorted_groups(group)
    key = [(group[i], symbols[i, : sizes[i]].tolist()) for i in range(300)]
    assert [key[i] for i in order] == sorted(key)
    for a, b, n in zip(order, order[1:], shared[1:], strict=False):
        same = 0
        while group[a] == group[b] and same < min(sizes[a], sizes[b]) and symbols[a, same] == symbols[b, same]:
            same += 1
        assert n == same


def test_mixing(spark, docs, empty):
    got = rows(mixing.mix(docs))
    assert all(r.taken <= 2 * r.size for r in got.values())
    for s in {r.source for r in got.values()}:
        part = [r for r in got.values() if r.source == s]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 1
    assert mixing.mix(empty).count() == 0
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixing.repeated(docs).collect()) == sum(r.taken for r in got.values())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def _plain_simhash(text):
    votes = [0.0] * 64
    terms = re.findall(r"\w+", text.lower())
    for term in dict.fromkeys(terms):
        h = xxhash.xxh3_64(term.encode()).intdigest()
        for b in range(64):
            votes[b] += (1 + math.log(terms.count(term))) * (1 if h >> b & 1 else -1)
    return sum(1 << b for b in range(64) if votes[b] > 1e-9), [b for b in range(64) if abs(votes[b]) <= 1e-9]


def test_simhash(spark, docs, empty):
    for t in ["", "one", "a b a c a", "12 x_y Ünder the the THE", *[_prose(k) for k in (2, 9, 70)]]:
        want, even = _plain_simhash(t)
        mask = ~sum(1 << b for b in even)
        assert simhash.fingerprint(t) & mask == want & mask
    text = {k: t or "" for k, t in ROWS}
    order = sorted(text, reverse=True)
    got = rows(simhash.compare_edits(docs))
    for k, nxt in zip(order, order[1:] + order[:1], strict=True):
        half = len(text[k]) // 2
        edited = text[k][: len(text[k]) - half] + text[nxt][:half]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k].near_edited == simhash.likeness(simhash.fingerprint(text[k]), simhash.fingerprint(edited))
        assert got[k].near_next == simhash.likeness(simhash.fingerprint(text[k]), simhash.fingerprint(text[nxt]))
    assert got[1].fingerprint == got[2].fingerprint
    assert simhash.compare_edits(empty).count() == 0
    prints = sorted({random.getrandbits(64) ^ 0 for _ in range(50)})
    prints += [p ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for p in prints]
    signed = sorted({simhash._signed(p) for p in prints})
    found = {(r.a, r.b) for r in simhash.within_radius(spark.createDataFrame([(p,) for p in signed], "fingerprint long")).collect()}
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_substrings_split_grams_where_texts_are_read(spark, monkeypatch):
    """The first halves of large grams equal those found by shuffling texts, and no text is shuffled for them."""
    base = "the very same passage that all of these documents hold somewhere inside them, once"
    docs = spark.createDataFrame([(i, f"{i * 7919:060d} {base} {i * 104729:070d}") for i in range(60)] + [(60, None), (61, "")], "doc long, text string")
    sifted = materialise(substrings._sift(substrings._anchor_rows(docs)))
    rest = sifted.where("key is not null").selectExpr("key", "doc", "at", "0 as low", f"{substrings.LEFT} as high")
    many = rest.groupBy("key").count().where("count > 20").select("key")
    hot = rest.join(many, "key", "left_semi")
    want = sorted(map(tuple, substrings._at_places(docs, hot, substrings._halves, substrings._PLACES).collect()))
    assert want and sorted(map(tuple, substrings._gram_halves(docs, hot, many).collect())) == want


def test_simhash_search_keeps_only_keys_of_queries(spark):
    """All keys are dealt once; what no query shares is gone before keys are counted or paired."""
    rng = random.Random(3)
    table = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(2000)], "fingerprint long")
    asked = table.limit(5).localCheckpoint()
    with tracked() as tables:
        found = {(r.a, r.b) for r in simhash.search(asked, table).collect()}
    assert {(r.fingerprint,) * 2 for r in asked.collect()} <= found
    keys = {(r.t, r.key) for r in simhash._keys(asked, simhash._tables(3, 6), "a").collect()}
    assert tables[0].columns == ["t", "key", "b"] and {(r.t, r.key) for r in tables[0].collect()} == keys


def test_simhash_search(spark):
    """op7 searches its queries in all rows; keys that many fingerprints share are cut further and lose nothing."""
    got = simhash.op7_simhash(spark, SF).collect()
    prints = [int(r.fingerprint, 16) for r in got]
    assert {r.doc_id for r in got if r.n_near is not None} == {r.doc_id for r in got if r.doc_id % simhash.QUERY_STEP == 0}
    assert all(r.n_near == sum((int(r.fingerprint, 16) ^ p).bit_count() <= 3 for p in prints) - 1 for r in got if r.n_near is not None)
    one = random.getrandbits(64)
    near = sorted({simhash._signed(one ^ sum(1 << b for b in random.sample(range(64), random.randrange(5)))) for _ in range(300)})
    table = spark.createDataFrame([(p,) for p in near], "fingerprint long")
    found = {(r.a, r.b) for r in simhash.search(table.limit(20), table, most=4).collect()}
    asked = [r.fingerprint for r in table.limit(20).collect()]
    assert found == {(a, b) for a in asked for b in near if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_sharding(docs, empty):
    got = sharding.shard_by_bytes(docs, 4).collect()
    text = dict(ROWS)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    by = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in by] == sorted(text)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_by_bytes(empty).count() == 0


def test_sharding_law(spark):
    """Totals far over 32 bits, a tiny last row: shards stay below their number and near equal, in order."""
    rnd = random.Random(3)
    sizes = [rnd.randrange(8, 4_000_000_000_000) for _ in range(3000)] + [8]
    rows = spark.createDataFrame([(i, n, i % 7) for i, n in enumerate(sizes)], "doc_id long, size long, text_crc32 long")
    got = sorted(sharding.cut_evenly(rows, 24).collect(), key=lambda r: r.doc_id)
    assert [r.shard for r in got] == sorted(r.shard for r in got) and {r.shard for r in got} == set(range(24))
    held = [sum(r.size for r in got if r.shard == s) for s in range(24)]
    assert all(abs(24 * h - sum(sizes)) <= 24 * max(sizes) for h in held)
    upto = 0
    for r in got:
        assert r.shard == (upto + r.size - r.size // 2 - 1) * 24 // sum(sizes)
        upto += r.size
    ties = spark.createDataFrame([(1, 10, 5)] * 6 + [(None, 10, 5)] * 2, "doc_id long, size long, text_crc32 long")
    assert sorted((r.shard, r.slot) for r in sharding.cut_evenly(ties, 4).collect()) == [(s, k) for s in range(4) for k in range(2)]


def test_awkward_rows(spark):
    """Repeated and null ids, null and empty texts, and extra columns named like an operator's own: whole results, no error."""
    path = P.path("byte_bpe_50k.tiktoken")
    data = [(3, _BASE), (3, _BASE), (3, "other words"), (None, _BASE), (None, None), (4, ""), (None, ""), (5, "x " * 70), (5, None)]
    names = "_tid _id n_lines n_removed _copy _score row key id place taken size words old bits part shard h".split()
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(k, t, None if k == 3 else "s", "en", *names) for k, t in data], schema)
    n = len(data)
    assert minhash.near_duplicates(docs).count() == n
    assert byte_bpe.round_trip(docs, path, P.PATTERN).count() == n
    assert substrings.without_repeats(docs).count() == n
    assert mixing.mix(docs).count() == n
    assert simhash.count_near(materialise(simhash.compare_edits(docs))).count() == n
    assert sharding.shard_by_bytes(docs).count() == n
    assert wavelet.read_shards(wavelet.write_shards(docs, P.path("byte_bpe_50k.json"))).count() == n
    assert language.predict(docs, language.learn(docs)).count() == n
    kept = lines.reduced(docs)
    assert sorted((r.row.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, _BASE), (0, ""), (0, ""), (3, ""), (3, ""), (3, "other words"), (4, ""), (5, "x " * 70), (5, "")])
    assert all(r.row[c] == c for r in kept.collect() for c in names)
    again = mixing.repeated(docs)
    assert again.columns == docs.columns and all(r[c] == c for r in again.collect() for c in names)
    assert sorted((r.doc_id or 0, r.text) for r in again.collect()) == sorted((r.doc_id or 0, r.text) for r in mixing.repeated(docs).collect())


def test_lines_are_split_and_hashed_once(spark):
    """No condition is pushed below the hashing of words, and no text is split within a function over its lines."""
    docs = spark.createDataFrame([(1, "a b\nc d\n \t"), (2, "a b\n\nE f"), (3, None)], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(lines._hashed_lines(docs)).count("array_distinct(") == 1
    assert sorted((r.doc_id, r.no, len(r.h)) for r in lines._hashed_lines(docs).collect()) == [(1, 0, 2), (1, 1, 2), (2, 0, 2), (2, 2, 2)]
    kept = lines.reduced(docs)
    assert "get(split(" not in plan(kept)
    assert sorted((r.row.doc_id, r.text, r.n_lines, r.n_removed) for r in kept.collect()) == [(1, "a b\nc d\n \t", 3, 0), (2, "\nE f", 3, 1), (3, None, 0, 0)]


def test_line_tokens(spark, monkeypatch):
    """Only the first words of a line are stored, and similar lines share a token there: within the index length the smaller one."""
    stored, write = [], lines.materialise
    monkeypatch.setattr(lines, "materialise", lambda df: stored.append(df.columns) or write(df))
    rnd = random.Random(5)
    data, sets = [], []
    for k in range(120):
        n = rnd.randrange(1, 60)
        base = [f"{'x' * rnd.randrange(6)}{rnd.randrange(10**6)}" for _ in range(n)]
        for words in (base, base[rnd.randrange(n // 5 + 1) :] + [f"n{rnd.randrange(10**6)}" for _ in range(rnd.randrange(n // 4 + 1))]):
            data.append((len(data), " ".join(words)))
            sets.append(set(words))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert lines.without_similar_lines(docs).count() == len(data)
    assert not any("h" in columns for columns in stored)
    table = lines._line_table(lines._hashed_lines(docs), 80)
    tokens = {k: [] for k, _ in data}
    for r in sorted(lines._tokens(table, 80, "doc_id").collect()):
        tokens[r.doc_id].append(r.token)
    assert all(len(tokens[k]) == min(len(s), 40 * len(s) // 100 + 1) for k, s in enumerate(sets))
    similar = 0
    for a in range(0, len(data), 2):
        b = a + 1
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            small, large = sorted((a, b), key=lambda k: len(sets[k]))
            shown = min(len(sets[small]), 60 * len(sets[small]) // 180 + 1)
            assert set(tokens[small][:shown]) & set(tokens[large])
            similar += 1
    assert 20 < similar < 120


def test_many_similar_lines(spark):
    """A group of hundreds of lines that are alike in part, beside as many that are not: the same lines go as by brute force."""
    rnd = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    base = rnd.sample(vocabulary, 30)
    data = []
    for k in range(400):
        words = list(base)
        for at in rnd.sample(range(30), rnd.randrange(0, 8)):
            words[at] = f"e{rnd.randrange(5000)}"
        rnd.shuffle(words)
        data.append((k, " ".join(words) + "\n" + " ".join(rnd.sample(vocabulary, rnd.randrange(1, 40)))))
    seen, want = [], {}
    for k, t in data:
        kept = []
        for line in t.split("\n"):
            words = set(line.split())
            if all(5 * len(words & s) < 4 * len(words | s) for s in seen):
                kept.append(line)
            seen.append(words)
        want[k] = "\n".join(kept)
    assert {k: r.text for k, r in rows(lines.without_similar_lines(spark.createDataFrame(data, "doc_id long, text string"))).items()} == want


@pytest.mark.parametrize("part", [8, 4096])
def test_matches_in_long_posting_lists_are_found(spark, monkeypatch, part):
    """Few words, so that lists are longer than what a line meets at once, with and without lists cut into parts."""
    monkeypatch.setattr(lines, "PART", part)
    draw = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    drawn = [draw.sample(words, draw.randint(4, 14)) for _ in range(160)]
    for k in range(0, 160, 4):  # a near copy of an earlier line, two words off at most
        drawn.append((drawn[k] + draw.sample(words, 1))[draw.randint(0, 1):])
    data = [(k // 4, [" ".join(x) for x in drawn[k : k + 4]]) for k in range(0, len(drawn), 4)]
    sets, want = [], {}
    for doc, texts in data:
        kept = []
        for text in texts:
            mine = set(text.split())
            if not any(100 * len(mine & x) >= 80 * len(mine | x) for x in sets):
                kept.append(text)
            sets.append(mine)
        want[doc] = "\n".join(kept)
    found = lines.without_similar_lines(spark.createDataFrame([(d, "\n".join(t)) for d, t in data], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in found.collect()} == want
    assert sum(t.count("\n") + 1 for t in want.values() if t) < len(drawn)


@pytest.mark.parametrize(("size", "long"), [(20, False), (32, False), (60, True)])
def test_lists_of_medium_length_are_done_at_once(spark, size, long):
    """All members of such a list meet at once and leave no postings to be joined later; those of longer ones do."""
    shared = ["x" * 30, "y" * 29]
    data = [(k, " ".join([*shared, *[f"a{k}b{j}" for j in range(8)]])) for k in range(size - 1)]
    data.append((size - 1, data[3][1] + " more"))
    table = materialise(lines._line_table(lines._hashed_lines(spark.createDataFrame(data, "doc_id long, text string")), 80))
    firsts = lines._firsts(table, 0).unionByName(lines._firsts(table, 1))
    ids = {r.id: r.doc_id for r in firsts.collect()}
    found = [r for part in range(lines.PASSES) for r in lines._near(firsts, 80, part, F.lit(1).cast("long")).collect()]
    assert sorted(ids[r.id] for r in found if r.eid is None) == (list(range(size)) if long else [])
    matches = [(ids[r.id], ids[r.eid], r.whole) for r in found if r.eid is not None]
    assert (size - 1, 3, True) in matches and all(a > b for a, b, _ in matches)
    assert long or len({r.token for r in found}) == 1


def test_size_classes_hold_all_similar_sizes(spark):
    """Each size that a similar set can have is in one of the classes, and most sizes look into one or two."""
    sizes = spark.range(1, 400).select(F.col("id").cast("int").alias("n"))
    one = {r.n: r for r in sizes.select("n", *[f(F.col("n")).alias(c) for c, f in {"own": lambda n: lines._size_class(n, 80), "up": lambda n: lines._classes(n, F.lit(True), 80), "down": lambda n: lines._classes(n, F.lit(False), 80)}.items()]).collect()}
    for n, r in one.items():
        near = [m for m in one if 100 * min(n, m) >= 80 * max(n, m)]
        assert {one[m].own for m in near} <= set(r.up) and {one[m].own for m in near if m <= n} <= set(r.down)
    assert max(len(r.up) for r in one.values()) <= 2
    assert sum(len(r.up) for r in one.values()) < 1.8 * len(one)


def test_vectors_of_several_lengths(spark):
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.01, 0.0]), (5, [1.0]), (6, [0.0, 1.0, 0.0])]
    got = rows(neighbours.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")), "vec_id")
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (1, 3, False), 5: (0, 5, True), 6: (0, 6, True)}


def test_wavelet(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got, start = rows(wavelet.read_shards(wavelet.write_shards(docs, path, shard_tokens=500))), 0
    for k, t in sorted(ROWS):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert wavelet.read_shards(wavelet.write_shards(empty, path)).count() == 0


def test_wavelet_added_token_and_width():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "x1<|endoftext|>\n\ny", "word<|endoftext|><|endoftext|>word", "<|endoftext", "so  <|endoftext|>  it's"]
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0] and [x.tolist() for x in wavelet.encoder(path)(texts)] == want
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.build(np.array([1, 65_536]), 16)


def test_wavelet_words_are_single_pre_tokens():
    """Words skip the pattern: each is one pre-token as it stands, and texts give the library's ids."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["don't we'll  x\n\nFoo Bar\u2019s", " \u00e9 \u00e8", "\tTab x1 y\u00b2\u00df", "\u00c0\u00d6\u00d8\u00d7\u00f7\u00f6 a<|endoftext|>b", "it's 's s'", "x\x1cy \u2003\u3000z", "", "  "]
    cut = [s for t in texts for s in segments.SEGMENT.findall(t)]
    words = [s for s in cut if segments.WORD.fullmatch(s)]
    assert "".join(cut) == "".join(texts) and len(words) > 4
    assert all(len(tokenizer.pre_tokenizer.pre_tokenize_str(w)) == 1 for w in words)
    assert [x.tolist() for x in wavelet.encoder(P.path("byte_bpe_50k.json"))(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_wavelet_queries():
    ids = np.random.default_rng(2).integers(0, 50, 9000)
    matrix, _, names = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 16).to_bytes(np.array([0]), [7]))
    long = np.random.default_rng(2).integers(0, 50, 2_000_000)
    part, _, _ = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(long, 16).to_bytes(np.array([0]), [7]))
    assert part.unpacked == 0 and part.access(1_234_567) == long[1_234_567] and part.unpacked <= 32 < 16 * 8
    assert names == [7]
    for at in (0, 1, 4095, 4096, 8999):
        assert matrix.access(at) == ids[at] and matrix.rank(int(ids[at]), at) == (ids[:at] == ids[at]).sum()
    places = np.flatnonzero(ids == 7)
    assert [matrix.select(7, k) for k in (0, 5, len(places) - 1, len(places))] == [*places[[0, 5, -1]], -1]
    assert (matrix.restore() == ids).all() and (part.restore() == long).all()


def test_language(spark, docs, empty):
    got = [r for r in language.op10_language_id(spark, SF).collect()]
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert held and sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    model = language.learn(docs)
    judged = rows(language.predict(docs, model))
    assert all(judged[k].lang_pred == "und" for k in (5, 6, 7))
    assert language.predict(empty, language.learn(empty)).count() == 0
    mixture = language.LanguageModel(["x", "y"], np.array([[0.9, 0.1]] * (language.DIMS // 2) + [[0.1, 0.9]] * (language.DIMS // 2)) / language.DIMS * 2)
    assert abs(sum(mixture.predict("some words here to mix of the two")[2].values()) - 1) < 1e-9


def test_language_mixture_is_the_likeliest():
    """The shares found by expectation-maximisation against a search of all shares in small steps."""
    rng = np.random.default_rng(5)
    table = rng.dirichlet(np.full(language.DIMS, 0.05), 2).T + 1e-9
    model = language.LanguageModel(["x", "y"], table / table.sum(0), steps=200)
    likely, counts = model.table[rng.integers(0, language.DIMS, 300)], rng.integers(1, 5, 300).astype(float)
    share, value = model._mix(likely, counts)
    every = [float(counts @ np.log(likely @ np.array([a, 1 - a]))) for a in np.linspace(0.0005, 0.9995, 2000)]
    assert value >= max(every) - 1e-3 and abs(share[0] - np.linspace(0.0005, 0.9995, 2000)[int(np.argmax(every))]) < 0.01


def test_language_without_letters():
    model = language.LanguageModel(["x", "y"], np.full((language.DIMS, 2), 1 / language.DIMS))
    assert [model.predict(t)[0] for t in ("½", "②", "Ⅷ", "12 - _", "", None)] == ["und"] * 6
    assert model.predict("a ½")[0] == "x"  # ties go to the first


def test_registry():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()] == list(range(1, 11))
