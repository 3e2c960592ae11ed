import numpy as np
import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ré", "su", "Te") for b in ("na", "po", "", "ßi") for c in ("r", "s", "the", "")]


def prose(rng, n):
    return " ".join(WORDS[i] + ("." if i % 11 == 0 else "") for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, source): copies, near copies, shared passages, repeated lines, and the odd rows every operator must bear."""
    rng = np.random.default_rng(5)
    out = []
    passage = prose(rng, 60)
    for i in range(60):
        t = prose(rng, int(rng.integers(5, 200)))
        out.append(t if i % 6 else t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :])
    base = prose(rng, 120).split()
    for _ in range(12):
        w = list(base)
        for k in rng.integers(0, len(w), 3):
            w[k] = "edit%d" % rng.integers(1000)
        out.append(" ".join(w))
    out += [out[3]] * 4 + [out[5].upper()]
    out += ["line one is here.\n" * 30 + prose(rng, 20), "the " * 300, "the " * 36, "the " * 20, " ".join("a%d" % (k % 7) for k in range(100))]
    out += [None, "", " \t\n", "word", "a\r\nb);\r\n  z\t\tq", "日本語 テ\x00キ <s> </s>", "▁ x▁▁ y", "x" * 5000, prose(rng, 9000)]
    rows = [(i, t, f"src{i % 3}" if i % 10 else None) for i, t in enumerate(out)]
    return rows + [(None, "no id at all", "src0"), (None, "no id at all", "src0"), (7, out[7], "src1"), (7, "another text of the same id", "src1")]


@pytest.fixture(scope="session")
def docs(spark, texts):
    df = spark.createDataFrame([(*r, "x", len(r[1] or "")) for r in texts], "doc_id long, text string, source string, lang string, n_chars long")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("1 = 0")
