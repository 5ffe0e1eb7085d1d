"""What parts ask for and are told moves packed, not as a row for each word and part."""

from strataloom.llm import lm


def moved(spark) -> int:
    """Bytes shuffled and written so far."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    rows = [stages.apply(i) for i in range(stages.size())]
    return sum(x.shuffleWriteBytes() + x.outputBytes() for x in rows)


def test_answers_move_packed(spark):
    words = [f"w{i}" for i in range(20_000)]
    rows = [(i, " ".join(words[(i * 37 + j * j) % 20_000] for j in range(400))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = moved(spark)
    scored = lm.score_texts(docs, part_bytes=40_000).collect()
    used = moved(spark) - before
    assert len(scored) == 400 and all(r["n_tokens"] == 401 for r in scored)
    assert used < 52 * 400 * 401  # 49 packed, 57 as rows
