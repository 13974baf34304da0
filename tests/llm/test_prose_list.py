import random

from twinsift.llm import queries
from twinsift.llm.quality import prose_policy, text_statistics

WORDS = ["the", "of", "and", "house", "river", "garden"]


def lines(rng, n_lines, stops, words):
    """Text of ``n_lines`` lines of ``words`` words, of which ``stops`` end in a stop, the others in a comma."""
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(words)) + (",.")[i < stops] for i in range(n_lines))


def test_prose_unlike_the_sample_is_found(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    texts = [lines(rng, 25, 25, 8) if i % 2 else lines(rng, 25, rng.randrange(0, 13), 8) for i in range(200)]
    texts += [lines(rng, 10, 5 + i % 5, 3 + i % 4) for i in range(50)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(w,) for w in WORDS[:3]], "word string").write.parquet(f"{tmp_path}/common_words.parquet")
    # the sample has no document of the last fifty, as that of a large table may
    learned = []
    monkeypatch.setattr(queries, "learn_prose_rules", lambda r, p, f=queries.learn_prose_rules: learned.append(f(r.where("doc_id < 200"), p)) or learned[0])
    rows = text_statistics(queries.table(spark, str(tmp_path), "documents"), queries.table(spark, str(tmp_path), "common_words"))
    want = sorted(r[0] for r in rows.where(prose_policy()).select("doc_id").collect())
    assert len(want) > 130
    got = sorted(r[0] for r in queries.p9_found(spark, str(tmp_path)).collect())
    assert learned[0] and got == want
    missed = rows.where(prose_policy() & (queries.F.expr(queries.rules_sql(learned[0])) != "prose")).count()
    assert missed
    assert queries.complete_rules(rows, prose_policy(), learned[0])
