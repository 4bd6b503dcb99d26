"""Template canonicalisation on planted copies and look-alikes."""

import pyarrow as pa

from tests.llm.conftest import sample
from versekit.llm import templates
from versekit.llm.textbuf import utf8

ITEM = ("Anna Miller buys 12 apples for 3.50 dollars at the market. How much money does Anna have left if she "
        "started the day with 20 dollars and gave 12 apples to Peter?")


def kinds(text):
    data, off = utf8(pa.array([text]))
    return templates.template_tokens(data, off)[1].tolist()


def test_token_kinds():
    assert kinds("We met Anna in Paris. Then 3,450.5 km and 5kg, two days") == [0, 0, 3, 0, 3, 0, 1, 2, 0, 1, 2, 1, 2]
    assert kinds("a 1.") == [0, 1] and kinds("") == [] and kinds("été Été à Épinal") == [0, 3, 0, 3] and kinds("x “y” — z…") == [0, 0, 0]
    a, b = (utf8(pa.array([t])) for t in ("ÉTÉ Noël 1,5", "été noël 1,5"))
    assert templates.template_tokens(*a)[2].tolist() == templates.template_tokens(*b)[2].tolist()


def test_planted(spark):
    fill = "some words before that nobody asked for and more of them , "
    ren = ITEM.replace("Anna Miller", "Carl Weber").replace("Anna", "Carl").replace("12", "7").replace("3.50", "2.25").replace("20", "31").replace("Peter", "Mona")
    mixed = ITEM.replace("12 apples for", "7 apples for").replace("with 20", "with 7").replace("left", "over")
    docs = [(1, fill + ITEM + " " + fill), (2, fill * 20 + ren), (3, ITEM.lower()), (4, fill * 3), (5, ITEM.upper()),
            (6, " ".join(ITEM.replace(".", "").replace("?", "").replace(",", "").split())), (7, None), (8, ""), (1, fill + ITEM + " " + fill),
            (9, ITEM[:60]), (None, ITEM), (10, ITEM.replace("market", "big market")),
            # every number differs from place to place: the skeleton alone
            (11, "Anna Miller buys 12 apples for 3.50 dollars at the market. How much money does Zoe have left if she started the day with 3.50 dollars and gave 99 apples to Zoe?"),
            (12, mixed)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(100, ITEM), (101, "too short"), (102, None), (103, ""), (100, ITEM)], "item_id long, text string")
    got = templates.contaminated(df, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 100), (1, 100), (2, 100), (3, 100), (5, 100), (6, 100), (10, 100)]
    one = [r for r in got if r["doc_id"] == 1][0]
    assert one["matched"] == one["item_windows"] == len(kinds(ITEM)) - 4 and one["start_token"] == len(kinds(fill))
    assert templates.contaminated(df.limit(0), bench).count() == 0 and templates.contaminated(df, bench.limit(0)).count() == 0


def test_names_that_open_sentences(spark):
    item = "Tom has 5 apples. Tom gives 2 to Mary. Mary eats 1 of them. Mary buys 4 more. How many apples do they have now?"
    ren = item.replace("Tom", "Carl").replace("Mary", "Zoe").replace("5", "9").replace("2", "3").replace("4", "6")
    # another skeleton: the names stand for different ones from place to place
    mixed = "Carl has 9 apples. Zoe gives 3 to Anna. Peter eats 1 of them. Mona buys 6 more. How many apples do they have now?"
    docs = [(1, "Some words before. " + ren + " And more."), (2, item.lower()), (3, mixed), (4, item)]
    got = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 4]


def test_without_the_local_filter(spark, monkeypatch):
    docs, bench = sample(), sample("benchmark")
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs][:250], "doc_id long, text string")
    items = spark.createDataFrame([(r["item_id"], r["text"]) for r in bench], "item_id long, text string")
    want = sorted(map(tuple, templates.contaminated(df, items).collect()))
    monkeypatch.setattr(templates, "MAX_LOCAL", 3)
    assert sorted(map(tuple, templates.contaminated(df, items).collect())) == want


def test_whole_tables(spark):
    docs, bench = sample(), sample("benchmark")
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(r["item_id"], r["text"]) for r in bench], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in templates.contaminated(df, items).collect()}
    want = {(d["doc_id"], b["item_id"]) for d in docs for b in bench if b["text"] in d["text"]}
    assert want <= got and len(got) <= 1.1 * len(want) + 2 and len(want) > 10
