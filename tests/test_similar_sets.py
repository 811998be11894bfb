import random

from tessella.plans import catalog


def test_pairs_equal_brute_force(spark):
    """Short words only: no pair here shares a word of nine letters, and near-exact copies must be found all the same."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = {i: r.sample(vocabulary, r.randint(1, 12)) for i in range(30)}
    docs = {i: list(dict.fromkeys([*r.sample(items[i % 30], r.randint(0, len(items[i % 30]))), *r.sample(vocabulary, r.randint(0, 8))])) for i in range(80)}
    items[30], docs[80] = [], []
    docs[81] = items[3]
    b = spark.createDataFrame(list(items.items()), "item_id long, bw array<string>")
    d = spark.createDataFrame(list(docs.items()), "doc_id long, dw array<string>")
    got = {(x["item_id"], x["doc_id"]): x["sim"] for x in catalog.similar_sets(b, d).collect()}
    want = {}
    for i, x in items.items():
        for k, y in docs.items():
            n = len(set(x) & set(y))
            if n and 5 * n >= 2 * (len(x) + len(y) - n):
                want[i, k] = round(n / (len(x) + len(y) - n), 6)
    assert got == want and got[3, 81] == 1.0 and len(got) > 20
