import random
import re
from collections import Counter

import pytest

from stallwise.llm import quality_rules
from stallwise.llm.contracts_sql import SQL
from stallwise.llm.quality_rules import RuleSettings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = {g for g, n in Counter(windows).items() if n > 1}
    covered = {j for i, g in enumerate(windows) if g in many for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_measures_against_brute_force(spark):
    dice = random.Random(3)
    texts = [None, "", " \n\t ", "a b", "a a a", "a a a a", "x\ny\nx\nx \n \n", "é # ü|$ %<>\x0b&*", "one two three one two three four",
             " ".join(dice.choice("abc") for _ in range(4000)), "".join(dice.choice("ab \n#\t") for _ in range(3000)), "z" * 50000]
    texts += [" ".join(dice.choice(["ab", "c", "d\n", "é"]) for _ in range(dice.randrange(120))) for _ in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rid", "2 as lines", "3 as w", "4 as t")
    got = quality_rules.judged(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def _word(*numbers):
    """Letters only: normalised lines do not tell digits apart."""
    return "".join(chr(97 + n % 26) + chr(97 + n // 26) for n in numbers)


def _text(i, own):
    lines = [" ".join(_word(i, j, k) for k in range(12)) for j in range(own)]
    return "\n".join(["Accept all COOKIES 2024 on this site please now", *lines])


def test_common_lines_deplete_documents_but_copies_do_not(spark):
    few = RuleSettings(least_documents=5, share=0.05, kept_share=0.5)
    notice = "Accept all cookies 1999 on  this site please now"
    rows = [(i, _text(i, 5), "en", "a.example", 0) for i in range(20)]
    rows += [(100 + i, "\n".join([notice] * 6 + [_word(i, 3) + " " + _word(i, 4)] * 1), "en", "a.example", 0) for i in range(3)]
    # a document with forty near copies is about one document: none of its lines is common
    story = "\n".join(" ".join(f"wonderful{_word(j)} story{_word(k)} of{_word(k)}" for k in range(12)) for j in range(6))
    rows += [(200 + i, story + "\nnear copy " + _word(i), "en", "b.example", 0) for i in range(40)] + [(300, "\n".join([notice] * 8), "en", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality_rules.judged(docs, settings=few).collect()}
    assert all(got[i].kept and got[i].removed_words == 9 for i in range(20))
    assert all(got[i].removed_words == 54 and not got[i].kept for i in range(100, 103))
    assert all(got[i].kept and got[i].removed_words == 0 for i in range(200, 240))
    assert got[300].removed_words == 0
    kept = quality_rules.keep_good(docs, settings=few)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


@pytest.mark.parametrize("own", [3, 5, 15])
def test_pages_of_one_template_are_documents_of_their_own(spark, own):
    template = "\n".join(" ".join(f"template{_word(i, j, 0)}" for j in range(10)) for i in range(6))
    rows = [(i, template + "\n" + " ".join(f"particular{_word(i % 26, i // 26, j)}" for j in range(own)), "en", "a.example", 0)
            for i in range(100)]
    rows += [(100 + i, "\n".join(" ".join(f"another{_word(i, j, k)}" for k in range(12)) for j in range(6)), "en", "a.example", 0)
             for i in range(20)]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].removed_words == 60 and not got[i].kept for i in range(100))
    assert all(got[i].removed_words == 0 and got[i].kept for i in range(100, 120))


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judged(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1)], SCHEMA)
    plan = quality_rules.measures(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _near_copies(dice, groups):
    """Groups of ten texts of 300 words with at most two changed."""
    out = []
    for g in range(groups):
        base = [f"w{dice.randrange(10 ** 6)}" for _ in range(300)]
        for _ in range(10):
            words = list(base)
            for _ in range(dice.randrange(3)):
                words[dice.randrange(300)] = f"x{dice.randrange(10 ** 6)}"
            out.append("\n".join(" ".join(words[i:i + 20]) for i in range(0, 300, 20)))
    return out


def test_recall_of_copies_is_at_least_nine_in_ten(spark):
    texts = sorted(set(_near_copies(random.Random(8), 30)))
    sets = [set(zip(w, w[1:], w[2:])) for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.95 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    from pyspark.sql import functions as F
    found = quality_rules.measures(docs).withColumn("rid", F.monotonically_increasing_id()).withColumn("hk", F.lit(1).cast("long"))
    component = {r.node: r.component for r in quality_rules.copies(found, docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").alias("t")), 0.95).collect()}
    rows = found.withColumn("node", quality_rules.document_node()).select("doc_id", "node").collect()
    documents = len({component.get(r.node, r.node) for r in rows})
    merged, want = len(texts) - documents, len(texts) - len(set(root))
    assert want > 100 and 0.9 * want <= merged <= 1.05 * want


@pytest.mark.parametrize("own", [3, 15])
def test_check_sql_has_the_same_rule(spark, own):
    """Template pages, whose lines reach the limits, near copies, whose lines would if each counted, and a null host."""
    import duckdb
    import pandas as pd
    template = "\n".join(" ".join(f"template{_word(i, j, 0)}" for j in range(10)) for i in range(6))
    rows = [(i, template + "\n" + " ".join(f"particular{_word(i % 26, i // 26, j)}" for j in range(own)), "en", "a.example", 0) for i in range(60)]
    rows += [(100 + i, t, "en", "b.example", 0) for i, t in enumerate(_near_copies(random.Random(5), 8))]
    story = "\n".join(" ".join(f"wonderful{_word(j)} story{_word(k)} of{_word(k)}" for k in range(12)) for j in range(6))
    rows += [(300 + i, story + "\nnear copy " + _word(i), "en", None, 0) for i in range(40)] + [(400, None, None, None, 0), (401, "", "en", "a.example", 0)]
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    con.execute("CREATE VIEW documents AS SELECT doc_id, text, lang, source, n_chars FROM given")
    got = quality_rules.judged(spark.createDataFrame(rows, SCHEMA)).drop("host", "text_hash")
    names = sorted(got.columns)
    as_rows = sorted(tuple(r[c] for c in names) for r in got.collect())
    want = con.execute(SQL["op3_quality_rules"]).fetchall()
    order = [d[0] for d in con.description]
    assert as_rows == sorted(tuple(r[order.index(c)] for c in names) for r in want)
    assert any(r[names.index("removed_words")] for r in as_rows)


def test_no_copy_is_lost_in_a_crowd(spark):
    """Pages that share most of their text all meet; each has one true copy, which none of the others is."""
    dice = random.Random(11)
    common = [_word(dice.randrange(676), dice.randrange(676)) for _ in range(900)]
    rows = []
    for i in range(150):
        own = [_word(i, dice.randrange(676), dice.randrange(676), j) for j in range(90)]
        rows += [(2 * i, " ".join(common + own), "en", "s", 0), (2 * i + 1, " ".join(common + own[:-1] + ["z"]), "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = quality_rules.measures(docs).selectExpr("*", "doc_id as rid", "xxhash64(host) as hk").cache()
    texts = docs.selectExpr("xxhash64(text) as text_hash", "text as t")
    same = quality_rules.copies(found, texts, 0.95).withColumnRenamed("node", "n")
    named = found.withColumn("n", quality_rules.document_node()).join(same, "n").select("doc_id", "component").collect()
    groups = {}
    for r in named:
        groups.setdefault(r.component, set()).add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == [[2 * i, 2 * i + 1] for i in range(150)]
