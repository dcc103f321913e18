"""Line pairs in batches, each compared under one key only; what Python workers keep between operators."""

import random

from scorelens.llm import common, line_dedup, packing


def test_pairs_at_once_equal_single_distances():
    rng = random.Random(7)
    for turn in range(120):
        letters = "ab c" if turn % 2 else "abcdefghij é漢𝄞"
        pairs = []
        for _ in range(rng.randint(1, 12)):
            text = "".join(rng.choices(letters, k=rng.randint(1, 150)))
            other = list(text)
            for _ in range(rng.randint(0, len(text) // 3)):
                other[rng.randrange(len(other))] = rng.choice(["", *letters])
            pairs.append((text, rng.choice(["".join(other) or "a", "".join(rng.choices(letters, k=rng.randint(1, 150)))])))
        most = [rng.randint(0, 40) + 1e-9 for _ in pairs]
        got = line_dedup.pairs_within(pairs, most, batch=rng.choice([50, 500, 32_768]), step=rng.choice([3, 16, 64])).tolist()
        assert got == [line_dedup.edit_distance(a, b) <= m for (a, b), m in zip(pairs, most)]


def test_few_lines_are_compared_in_all_pairs():
    rng = random.Random(2)
    groups = []
    for k in range(30):
        line = "".join(rng.choices("abcdef ", k=rng.choice([20, 90, 2500])))
        variants = [line[:at] + "xyz" + line[at + rng.choice([3, 12]):] for at in rng.sample(range(len(line)), 4)]
        groups.append([{"node": 10 * k + n, "line": v} for n, v in enumerate([line, *variants])])
    groups.append(groups[0][:3])  # pairs that stand in two groups come once
    want = {(a["node"], b["node"]) for g in groups for a in g for b in g if a["node"] < b["node"] and line_dedup.similar(a["line"], b["line"], 0.8)}
    got = line_dedup.few_links(groups, 0.8)
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want


def test_a_pair_is_compared_under_its_first_key_only(spark, monkeypatch):
    """Lines that share a long passage share several keys, whose groups differ; before, they were compared in each."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage = letters(150)
    lines = [passage + letters(60) if k % 4 else passage[20:] + letters(90) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    met = {n: list(map(int, line_dedup.gram_keys([line_dedup.normalise(line)])[0])) for n, line in enumerate(lines)}
    nodes = spark.createDataFrame([(n, len(lines[n]), keys) for n, keys in met.items()], "node long, size int, keys array<int>")
    found = line_dedup.key_buckets(nodes, line_dedup.KEYS, 16).collect()
    pairs = {}

    def similar_to(line, others, least):
        for other in others:
            pair = frozenset((line, other))
            pairs[pair] = pairs.get(pair, 0) + 1
        return __import__("numpy").zeros(len(others), dtype=bool)

    monkeypatch.setattr(line_dedup, "similar_to", similar_to)
    for r in found:
        k, shorter = divmod(r["code"], line_dedup.CODES)
        ranked = sorted(r["nodes"], key=lambda n: (len(lines[n]), n))
        members = [{"node": n, "low": (rank < shorter) if shorter else None, "line": line_dedup.normalise(lines[n])} for rank, n in enumerate(ranked)]
        line_dedup.similar_links(members, 0.8, line_dedup.KEYS, k)
    assert pairs and max(pairs.values()) == 1
    monkeypatch.undo()
    everything = line_dedup.similar_links([{"node": n, "line": line_dedup.normalise(line)} for n, line in enumerate(lines)], 0.8)
    gone = line_dedup.dedup_lines(docs, keys=line_dedup.KEYS, limit=16).where("size(removed_lines) > 0").count()
    assert gone == len(everything)


def test_workers_keep_nothing_of_another_operator(spark):
    """Before, a worker that had packed held its tokenizer and units while later stages ran."""
    docs = spark.createDataFrame([(k, f"some words of document {k}") for k in range(8)], "doc_id long, text string").repartition(1)

    def held(operator):
        rows = common.map_batches(docs.select("doc_id"), lambda: lambda c: {"n": [len(_kept()) for _ in c["doc_id"]]}, "n int", operator)
        return {r["n"] for r in rows.collect()}

    def _kept():
        from scorelens.llm import common
        return common._KEPT

    assert packing.pack(docs).count() == 8
    assert held(packing.PACKING) <= {0, 1}
    assert held("") == {0}
    common.kept("one", "a", len)
    assert common.kept("one", "a", len) == 1 and list(common._KEPT) == [("one", "a")]
    assert common.kept("two", "abc", len) == 3 and list(common._KEPT) == [("two", "abc")]
    common.forget_others("one")
    assert not common._KEPT


def test_batches_are_handed_on_in_slices_of_the_size_asked_for(spark):
    docs = spark.createDataFrame([(k, "x" * 1000) for k in range(100)], "doc_id long, text string").repartition(1)

    def sizes(**bound):
        return {r["n"] for r in common.map_batches(docs, lambda: lambda c: {"n": [len(c["text"])] * len(c["text"])}, "n int", **bound).collect()}

    assert sizes() == {100}
    assert max(sizes(slice_bytes=10_000)) <= 10
