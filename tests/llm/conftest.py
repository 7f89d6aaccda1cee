import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): plain, near copies, exact copies, null, empty, short, non-Latin, long."""
    import random

    r = random.Random(3)
    words = ["".join(r.choice("aeioustrnml") for _ in range(r.randint(2, 7))) for _ in range(300)]
    plain = [[r.choice(words) for _ in range(r.randint(30, 120))] for _ in range(25)]
    out = [" ".join(w) for w in plain]
    for w in plain[:8]:
        for k in (1, 3, 9):
            v = list(w)
            v[r.randrange(len(v))] = f"swap{k}"
            out.append(" ".join(v[k:]))
    passage = " ".join(r.choice(words) for _ in range(25))
    out += [f"{o[:50]} {passage} {o[60:90]}" for o in out[10:16]]
    out += [out[0], out[0], out[5], None, "", "  \t\n", "Two words", "two WORDS", "été été ÉTÉ naïve 日本語 テキスト " * 9, "x" * 200, "long " * 3000]
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture()
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src") for i, t in texts], "doc_id long, text string, lang string, rep string")
