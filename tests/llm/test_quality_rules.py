import math
import random
import re

from versespan.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string"
PROSE = "the of and to it is a good day for that in the house of the rising sun, and so on. "


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(frame):
    texts = [None, "", " \n\t", "a", "a a a a", "x y z x y z x", "a\nb\n\n \na\nb\nb", "né #$ ü|é\x85",
             "w " * 3000, "a b c d a b c e\x0bf", PROSE * 3, "one\x1ctwo three"]
    df = frame(SCHEMA, *[(i, t, None) for i, t in enumerate(texts)])
    for r in Q.rule_features(df).collect():
        f = r["rule"]
        assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"],
                f["n_repeat_words"]) == brute(r["text"]), r["text"][:20]
        assert sum(f["chars"]) == len(r["text"] or "")


def test_divergent_documents_go_and_short_ones_stay(spark, frame):
    names = [f"the alpha{i} of beta{i} and gamma{i} to delta{i} in" for i in range(300)]
    good = [(i, " ".join(names[i * 9:i * 9 + 9]).capitalize() + ".", "en") for i in range(30)]
    loud = (90, " ".join(f"{chr(65 + i % 26)}{chr(65 + i // 26)}LOUD!!" for i in range(200)), "en")
    short = (91, "###", "en")
    same = [(92, good[0][1], None)] * 2
    judged = Q.apply_rules(frame(SCHEMA + ", rule string, kept string",
                                 *[(*r, "x", "y") for r in [*good, loud, short, *same]]))
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in judged.collect()}
    assert judged.count() == 34
    assert kept[90] == (False, False) and kept[91] == (True, False) and kept[92] == (False, True)
    assert all(kept[i] == (False, True) for i in range(30))


def test_distance_equals_formula(frame):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.25, 0.0, 0.75]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    df = frame("p array<double>", (p,))
    got = df.select(Q.js_distance(F.col("p"), q).alias("d")).first()["d"]
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def test_no_documents_and_no_languages(frame):
    assert Q.apply_rules(frame(SCHEMA)).count() == 0
    row = Q.apply_rules(frame(SCHEMA, (1, PROSE * 4, None))).first()
    assert row["char_distance"] is None and row["base_failed"] == (not row["kept"])


def test_long_texts_without_common_words_go(frame):
    rng = random.Random(4)
    common = "the of and to in a is that for it".split()

    def prose(words):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else f"word{rng.random()}"
                        for _ in range(words)).capitalize() + "."

    good = [(i, prose(rng.choice([60, 120, 300, 900])), "en") for i in range(80)]
    bare = [(90 + i, " ".join(f"Word{rng.random()}" for _ in range(n)) + ".", "en")
            for i, n in enumerate((60, 120, 400, 2000))]
    rows = {r["doc_id"]: r for r in Q.apply_rules(frame(SCHEMA, *good, *bare)).collect()}
    assert not any(r["base_failed"] for r in rows.values())
    assert all(rows[i]["kept"] for i in range(80))
    assert rows[90]["kept"] and rows[90]["word_distance"] is None
    for i in (91, 92, 93):
        assert rows[i]["char_distance"] <= Q.MAX_CHAR_DISTANCE and not rows[i]["kept"]


def test_small_tables_have_references_of_small_languages(frame):
    rng = random.Random(6)

    def prose(common):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else f"word{rng.random()}"
                        for _ in range(300)).capitalize() + "."

    english = [(i, prose("the of and to in".split()), "en") for i in range(60)]
    german = [(100 + i, prose("der die und den von".split()), "de") for i in range(8)]
    other = [(200, prose(["x"]), "de")]
    rows = {r["doc_id"]: r for r in Q.apply_rules(frame(SCHEMA, *english, *german, *other)).collect()}
    assert not any(r["base_failed"] for r in rows.values())
    assert all(rows[i]["kept"] for i, *_ in english + german) and not rows[200]["kept"]
