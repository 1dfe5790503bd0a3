import os
import random

import pytest

from fathom.llm.packing import default_vocabulary, differencing, pack, pack_block, token_counts


def test_differencing_places_every_item_once():
    r = random.Random(1)
    for _ in range(30):
        sizes = [r.randint(1, 100) for _ in range(r.randint(1, 60))]
        m = r.randint(1, 12)
        packed = differencing(sizes, m)
        assert len(packed) <= m and sorted(i for _, x in packed for i in x) == list(range(len(sizes)))
        assert all(s == sum(sizes[i] for i in x) for s, x in packed)
    assert differencing([], 3) == []
    assert sorted(s for s, _ in differencing([8, 7, 6, 5, 4], 2)) == [14, 16]  # the textbook case
    assert [s for s, _ in differencing([4, 5, 6, 7, 8], 1)] == [30]


def test_near_equal_and_tight():
    r = random.Random(4)
    sizes = [min(2047, int(r.lognormvariate(5.2, 1))) + 1 for _ in range(3000)]
    packed = pack_block(sizes, 2048)
    assert max(s for s, _ in packed) <= 2048 and sum(sizes) / 2048 / len(packed) > 0.985
    assert sorted(i for _, x in packed for i in x) == list(range(3000))
    big = pack_block([2048] * 5 + [1500] * 7, 2048)
    assert len(big) == 12
    assert pack_block([], 2048) == []


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no tokenizers")
def test_pack(spark):
    import public_tokenizers  # noqa: F401

    r = random.Random(2)
    words = "store batch query index token ledger vector the of and".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 120))), "w") for i in range(400)]
    rows += [(1000, "alpha " * 900, "w"), (1001, None, "w"), (1002, "", "w"), (None, "x", "w"), (1003, "<|endoftext|>", "w"), (5, rows[5][1], "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, window string")
    out = pack(df, capacity=256, block_items=100).collect()
    fill = {}
    for p in out:
        fill[p["window"]] = fill.get(p["window"], 0) + p["tokens"]
    total = {(x["doc_id"]): x["tokens"] for x in token_counts(df).collect()}
    assert max(fill.values()) <= 256 and sum(fill.values()) == sum(total.values()) + total[5]
    pieces = {}
    for p in out:
        pieces.setdefault(p["doc_id"], []).append((p["first_token"], p["tokens"]))
    assert all(len(v) == (2 if k == 5 else 1) for k, v in pieces.items() if k != 1000)  # whole unless larger than a window
    whole = sorted(pieces[1000])
    assert whole[0] == (0, 256) and sum(n for _, n in whole) == total[1000] and all(a + n == b for (a, n), (b, _) in zip(whole, whole[1:]))
    assert 1001 not in pieces and 1002 not in pieces and 1003 in pieces
    assert sum(fill.values()) / 256 / len(fill) > 0.9
    assert pack(df.limit(0)).count() == 0


def test_vocabulary_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "Bonjour à tous")], "doc_id long, text string")
    other = default_vocabulary().replace("multi_", "")
    assert token_counts(df, vocabulary=other).first()["tokens"] != 0
