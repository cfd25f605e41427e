import random

from tests.llm import brute


def test_windows_that_share_a_key_stay_apart(spark):
    """With four bits of each key nearly all windows collide."""
    from anchorloom.llm import substring_dedup

    rng = random.Random(5)
    passages = [" ".join(f"w{rng.randrange(400)}" for _ in range(40)) for _ in range(6)]
    pairs = [(i, " ".join([*(f"u{i}x{k}" for k in range(30)), *rng.choices(passages, k=2), *(f"v{i}x{k}" for k in range(25))])) for i in range(40)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    made = [substring_dedup.remove(docs, bits=bits).orderBy("doc_id").collect() for bits in (4, 64)]
    assert made[0] == made[1] and sum(r.n_removed for r in made[0]) > 1000
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in made[0]), key=str) == brute.deduped(pairs)
