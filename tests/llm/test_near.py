from slateledger.llm import decontam

PHRASE = "one two three four five six seven eight nine ten eleven twelve thirteen"
MOVED = "zero one two three four six five seven eight nine ten extra eleven twelve thirteen more"


def near(spark, docs, parts):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts, "doc_id") if parts > 1 else spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = decontam.decontaminate(df, spark.createDataFrame([(1, PHRASE)], "item_id long, text string"))
    return {r.doc_id: (len(r.spans), r.n_near) for r in found.collect()}


def test_moved_words_beside_an_exact_copy_in_one_block(spark):
    half = PHRASE.split()
    docs = [(1, MOVED), (2, " ".join(half[:7])), (3, " ".join(half[7:])), (4, PHRASE), (5, "six " * 30 + MOVED), (6, f"{PHRASE} {'x ' * 40}{MOVED}")]
    got = near(spark, docs, 1)
    assert {d: (s, n > 0) for d, (s, n) in got.items()} == {1: (0, True), 2: (0, False), 3: (0, False), 4: (1, False), 5: (0, True), 6: (1, True)}
    assert near(spark, docs, 5) == got
