import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import simhash
from lodestar.llm.common import components


def plain_fingerprint(text):
    words, word = [], ""
    for ch in text or "":
        if ch in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    for text in (None, "", " \n\t", "One", "one Two", "a b c", "É é x\xa0y Z z", "the cat sat on the mat " * 50):
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


def test_golay_code_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    index = simhash.ball_indices(words)
    kinds = {len(set(row)) for row in index.tolist()}
    assert kinds <= {1, 6}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
def test_close_fingerprints_share_a_key(value, flips):
    other = value
    for b in flips:
        other ^= 1 << b
    both = np.array([value, other], dtype=np.uint64).view(np.int64)
    rows, keys = simhash.fuzzy_keys(both)
    assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_links_with_hot_buckets(spark, monkeypatch):
    rng = random.Random(3)
    centre, far = rng.getrandbits(64), [rng.getrandbits(64) for _ in range(60)]
    cloud = set(far)
    for _ in range(150):
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 3)):
            x ^= 1 << b
        cloud.add(x)
    fps = sorted(cloud)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    want = brute(fps)
    for limit in (simhash.PAIRED_BUCKET, 3):
        monkeypatch.setattr(simhash, "PAIRED_BUCKET", limit)
        nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
        roots = {r["node"]: r["root"] for r in components(simhash.links(nodes), "t").collect()}
        groups, expect = {}, {}
        for i, v in enumerate(signed):
            groups.setdefault(roots.get(v, v), set()).add(v)
            expect.setdefault(want[i], set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_near_duplicates_edge_cases(spark):
    long = "word " * 30000 + "end"
    rows = [(5, "a b c d"), (3, "A B  c\nd"), (9, None), (8, ""), (7, " \t"), (None, "a b c d"), (None, "lonely text here now"), (4, long), (4, long), (1, "x")]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fp", "component_id"]
    seen = sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=str)
    assert seen == sorted([(5, 3), (3, 3), (9, 7), (8, 7), (7, 7), (None, 3), (None, None), (4, 4), (4, 4), (1, 1)], key=str)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, 7, 4, 1, None], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(links, "chain").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_every_group_keeps_a_text(spark):
    alone, other, third = "lonely text here now", "quite another thing to read", "nothing like the ones before it"
    rows = [(3, "a b c d"), (None, "a b c d"), (None, alone), (None, other), (None, other), (7, third), (7, "some text under an id used twice"), (7, third), (8, third)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, component_id string").repartition(3)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    want = [(3, "a b c d"), (None, alone), (None, other), (7, third), (7, "some text under an id used twice")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
