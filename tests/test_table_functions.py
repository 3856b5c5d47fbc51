import random
import re

from quire.functions.table_functions import register, spans


def test_spans_in_sql(spark, rows):
    register(spark)
    texts = [(1, "v1.25 of é 7, a.b@c.de 😀3"), (2, None), (3, ""), (4, "x" * 50_000 + "9")]
    spark.createDataFrame(texts, "id long, text string").repartition(3).createOrReplaceTempView("span_texts")
    got = rows(spark.sql("select id, start, stop, kind, value from text_spans(table(span_texts))"))
    want = sorted(((i, a, b, k, v) for i, t in texts for k, a, b, v in spans(t or "")), key=repr)
    assert got == want and all(dict(texts)[i][a:b] == v for i, a, b, _, v in want)
    assert [v for _, _, _, v in spans("1.2.3")] == re.findall(r"[0-9]+(?:\.[0-9]+)?", "1.2.3")
    assert spark.sql("select * from text_spans(table(select id, text from span_texts where false))").count() == 0


def test_fold_along_a_group(spark):
    register(spark)
    rng = random.Random(2)
    data = [(i, rng.choice("abc"), rng.randrange(100_000), 500) for i in range(25_000)]
    spark.createDataFrame(data, "id long, k string, at long, gap long").createOrReplaceTempView("spaced")
    got = {r.id: r.kept for r in spark.sql("select * from spaced_rows(table(spaced) partition by k order by (at, id))").collect()}
    last, want = {}, {}
    for i, k, at, gap in sorted(data, key=lambda r: (r[2], r[0])):
        want[i] = k not in last or at - last[k] >= gap
        if want[i]:
            last[k] = at
    assert got == want
