"""Long runs in decontamination; all links of line dedup."""

import random

import numpy as np
import pytest

from netgauge.llm import decontam, line_dedup


def test_decontamination_takes_runs_of_any_length(spark):
    """Very many names or numbers in a row are one slot, and leave the executor its stack."""
    from pyspark.sql import functions as F

    item = "a train leaves Rome at 9 and goes on for many hours until it is at home"
    runs = ["Anna " * 30_000, "Anna\n" * 30_000, "1," * 30_000, "12:30/" * 30_000 + "4"]
    texts = [item.replace("Rome ", runs[0]), item.replace("9 ", runs[3] + " "), *runs, "Anna Bell\tCole 1,2:3/4.5 km 7, 8"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = docs.select(decontam.words(F.col("text")).alias("w"), decontam.slots(F.col("text")).alias("s")).collect()
    assert [len(r["w"]) for r in got] == [17, 17, 1, 1, 1, 1, 5]
    assert got[6]["w"] == [decontam.NAME, decontam.NUMBER, decontam.UNIT, decontam.NUMBER, decontam.NUMBER] and got[6]["s"] == ["anna bell cole", "1,2:3/4.5", "km", "7", "8"]
    found = decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {0, 1}


def variants(seed, n):
    """A line and n variants, of which most are near some of the others only."""
    rng = random.Random(seed)
    base = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(20))
    return [base] + ["".join(rng.choice("ABCDEFGH") if rng.random() < share else c for c in base) for share in (rng.choice([0.01, 0.02, 0.03]) for _ in range(n))]


def test_every_link_between_lines_counts(spark):
    """A line's links are all lines within the threshold, also those that its class doesn't need."""
    lines = list(dict.fromkeys(variants(1, 60) + variants(2, 3))) + ["a line of its own that is like no other one in this small corpus of lines"]
    limit = line_dedup.limits(np.asarray([len(x) for x in lines])).tolist()
    want = [sum(a != b and line_dedup.distance_within(a, b, min(limit[i], limit[j])) for j, b in enumerate(lines)) for i, a in enumerate(lines)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.digest(df, True).collect()}
    assert max(want) > 20 and [got[i]["n_links"] for i in range(len(lines))] == want


@pytest.mark.parametrize("share,many", [(50_000, 32), (7, 2)])
def test_classes_do_not_need_every_link(spark, monkeypatch, share, many):
    """The pipeline's classes are those of all links, however pairs are shared out, with fewer links in a family of variants."""
    monkeypatch.setattr(line_dedup, "SHARE", share)
    monkeypatch.setattr(line_dedup, "MANY", many)
    df = spark.createDataFrame(list(enumerate(x for k in range(4) for x in variants(k, 15 * k))), "doc_id long, text string")
    whole, less = (line_dedup.deduplicated(df, True, every).select("doc_id", "text", "n_removed", "removed", "n_links").collect() for every in (True, False))
    assert sorted(tuple(r)[:4] for r in whole) == sorted(tuple(r)[:4] for r in less)
    assert sum(r["n_removed"] for r in whole) > 50 and (many > 2 or sum(r["n_links"] for r in less) < sum(r["n_links"] for r in whole))


def test_pairs_are_verified_together_as_one_by_one():
    """Any length, limits of several words, alphabets of any size, pairs that end early and pairs far apart."""
    rng = random.Random(4)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz ", "".join(map(chr, range(0x4E00, 0x5200)))):
        for size in (12, 24, 61, 320, 700, 2600):
            pairs = []
            for _ in range(240):
                a = "".join(rng.choice(letters) for _ in range(size + rng.randrange(size // 8)))
                b = list(a) if rng.random() < 0.9 else [rng.choice(letters) for _ in range(size)]
                for _ in range(rng.randint(0, max(3, size // 10))):
                    k, kind = rng.randrange(len(b)), rng.random()
                    b[k : k + (kind < 0.7)] = [rng.choice(letters)] if kind > 0.2 else []
                pairs.append((a, "".join(b)) if len(a) >= len(b) else ("".join(b), a))
            limit = np.asarray([max(1, len(b) // 20) for _, b in pairs])
            assert line_dedup.within(pairs, int(limit.max()), limit).tolist() == [line_dedup.distance_within(a, b, t) for (a, b), t in zip(pairs, limit.tolist(), strict=True)]
