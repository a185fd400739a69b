"""One-permutation MinHash against the resemblance of shingle sets, and the query against a plain version."""

import hashlib
import random
import struct

import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import minhash, queries, succession
from tests.llm.test_operators import SPACED, edge, empty, lowered  # noqa: F401


def shingles(text, n=5):
    w = SPACED.findall(lowered(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def resemblance(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_bins(hashes, bins):
    shift = 64 - (bins.bit_length() - 1)
    out = {}
    for h in hashes:
        b = (h % 2**64) >> shift
        out[b] = min(out.get(b, 2**64), h % 2**64)
    # Bins are in the order of signed numbers.
    return [out.get((b + bins // 2) % bins) for b in range(bins)]


def test_bins_keep_the_least_hash_and_empty_ones_borrow(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randrange(-(2**63), 2**63) for _ in range(n)]) for k, n in enumerate((1, 2, 3, 10, 40, 100, 1000, 3000))]
    df = spark.createDataFrame(rows, "k int, h array<bigint>").withColumn("v", minhash.binned(F.col("h"), 64))
    got = df.withColumn("d", minhash.densified(F.col("v"), 64)).withColumn("p", minhash.low_bits(F.col("d"), 64, 4)).collect()
    for r in got:
        want = brute_bins(r["h"], 64)
        assert [None if x is None else x % 2**64 for x in r["v"]] == want
        assert len(r["d"]) == 64 and None not in r["d"]
        assert all(d == v for d, v in zip(r["d"], r["v"], strict=True) if v is not None)
        assert set(r["d"]) == {v for v in r["v"] if v is not None}
        nibbles = "".join(f"{x % 2**64:016x}" for x in r["p"])
        digest = lambda x, b: xxhash.xxh64_intdigest(struct.pack("<i", b), xxhash.xxh64_intdigest(struct.pack("<q", x), 42))
        assert nibbles == "".join(f"{digest(x, b) & 15:x}" for b, x in enumerate(r["d"]))


def test_empty_bins_borrow_from_all_alike(spark):
    """Two filled bins of 64 serve the 62 others about equally, over many texts."""
    rng = random.Random(2)
    rows = [([rng.randrange(-(2**63), 2**63) for _ in range(2)],) for _ in range(300)]
    dense = spark.createDataFrame(rows, "h array<bigint>").select(minhash.densified(minhash.binned(F.col("h"), 64), 64).alias("d")).collect()
    share = [sum(x == max(r["d"]) for x in r["d"]) / 64 for r in dense if len(set(r["d"])) == 2]
    assert 0.45 < sum(share) / len(share) < 0.55 and max(share) < 0.8


def test_likeness_estimates_resemblance(spark):
    rng, rows = random.Random(3), []
    for k in range(400):
        n = rng.choice((8, 20, 60, 300, 2000))
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        cut = rng.randrange(n)
        b[cut:] = [f"x{rng.randrange(10**6)}" for _ in range(n - cut)]
        rows.append((k, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = df.select("a", "b", minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("s")).collect()
    errors = [r["s"] - resemblance(shingles(r["a"]), shingles(r["b"])) for r in got]
    assert abs(sum(errors) / len(errors)) < 0.01
    assert sum(map(abs, errors)) / len(errors) < 0.03 and max(map(abs, errors)) < 0.2


def test_edges(spark, edge, empty):  # noqa: F811
    clashing = edge.withColumn("fingerprint", F.lit("clash")).withColumn("fp", F.lit("clash"))
    rows = minhash.minhash(clashing).collect()
    assert len(rows) == clashing.count()
    for r in rows:
        for s in rows:
            if lowered(r["text"]).split() == lowered(s["text"]).split():
                assert r["fingerprint"] == s["fingerprint"]
        assert len(r["fingerprint"]) == (16 if shingles(r["text"]) else 0)
    assert minhash.minhash(empty).count() == 0
    one = lambda a, b: spark.range(1).select(minhash.likeness(minhash.fingerprint(F.lit(a)), minhash.fingerprint(F.lit(b)))).first()[0]
    assert (one("", " "), one("", "a"), one("a", "a"), one("A b", "a\tb")) == (1.0, 0.0, 1.0, 1.0)


def test_next_row(spark):
    rng = random.Random(5)
    ids = rng.sample(range(-500, 500), 300)
    rows = [(i, f"v{i}") for i in ids] + [(None, "none")]
    got = {r["i"]: r["next_v"] for r in succession.with_next(spark.createDataFrame(rows, "i int, v string").repartition(7), ["i"], ["v"]).collect()}
    order = [None, *sorted(ids)]
    want = {i: "none" if order[(k + 1) % len(order)] is None else f"v{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    assert got == want
    alone = succession.with_next(spark.createDataFrame([(1, "x")], "i int, v string"), ["i"], ["v"]).collect()
    assert [r["next_v"] for r in alone] == ["x"]
    assert succession.with_next(spark.createDataFrame([], "i int, v string"), ["i"], ["v"]).count() == 0


def test_query_on_a_small_table(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i * 3, " ".join(rng.choices(("alpha", "Beta", "g漢", "\U0001f600"), k=rng.randrange(80)))) for i in range(120)]
    rows += [(1, None), (2, "short"), (None, "no id at all here"), (6, "a second text of six, which is another document")]
    rng.shuffle(rows)
    for copies in (1, 3):
        given = rows + [rows[4]] * (copies - 1)
        spark.createDataFrame(given, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/{copies}/documents.parquet")
        got = queries.op12_minhash(spark, f"{tmp_path}/{copies}").collect()
        assert len(got) == len(given)
        prints = {}
        texts = {(i, t or "") for i, t in rows}
        for r in got:
            k = r["n_chars"] // 4
            mine = [t for i, t in texts if i == r["doc_id"]]
            after = sorted({i for i, _ in texts if i is not None and (r["doc_id"] is None or i > r["doc_id"])})
            follow = [t for i, t in texts if i == (after[0] if after else None)] + (mine if len(mine) > 1 else [])
            follow += [t for i, t in texts if i == 6] if after and after[0] == 6 else []
            made = {hashlib.sha256((t[: len(t) - k] + f[:k]).encode()).hexdigest(): (t, t[: len(t) - k] + f[:k], f) for t in mine if len(t) == r["n_chars"] for f in follow}
            assert r["edited_sha256"] in made
            text, edited, following = made[r["edited_sha256"]]
            assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"] and prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
            assert abs(r["near_edited"] - resemblance(shingles(text), shingles(edited))) < 0.25
            assert abs(r["near_next"] - resemblance(shingles(text), shingles(following))) < 0.25
