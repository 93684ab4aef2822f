"""What the findings of round 3 named: each test failed before its change."""

from pyspark.sql import functions as F

from leafmill.operators import parse


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_json_titles_parse_each_text_once(spark):
    cases = {
        '{"bookName":"A"}': "A",
        '{"data":{"novel":{"articleName":"up","articlename":"low"}}}': "up",
        '{"book":{"name":"n","@type":"Book"},"data":"text"}': "n",
        '{"book":[{"bookName":"A"}],"props":{"pageProps":{"bookName":"deep"}}}': "deep",
        '{"isPartOf":{"novel":{"bookTitle":"z"}},"book":{"bookTitle":" higher "}}': "higher",
        '{"novel":{"book":{"bookInfo":{"bookName":"too deep"}}}}': None,
        '{"bookName":{"x":1},"data":"{\\"bookName\\":\\"inner\\"}"}': None,
        '[{"bookName":"A"}]': None,
        '{"bookName":"A"': None,
    }
    df = spark.createDataFrame([(j,) for j in cases], "j string").select("j", parse.json_find_title(F.col("j")).alias("t"))
    assert {r.j: r.t for r in df.collect()} == cases
    plan = optimized(df)
    assert plan.count("from_json") == 1 and "get_json_object" not in plan


def test_stream_failures_keep_every_user(spark, tmp_path):
    from leafmill.plans import stream_queries

    rows = [(u, u, f"2024-01-01 00:00:{u % 60:02}", "error") for u in range(1500)]
    rows += [(9000, 2000, "2024-01-01 00:00:05", "error"), (9001, 2000, "2024-01-01 00:00:05", "view")]  # not newer than the success
    rows += [(9002, None, "2024-01-01 00:00:05", "error"), (9003, 3, "2024-01-01 00:00:09", None)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string")
    events.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.target: r.n for r in stream_queries.stream_failures(spark, str(tmp_path)).collect()}
    assert got == {str(u): 1 for u in range(1500)}


def test_long_first_lines_are_compared_in_one_pass(spark):
    """The lines' characters were looked up one by one in the other line, which was cleaned anew for each."""
    import time

    from leafmill.functions import text as T

    long = "".join(chr(0x4E00 + k % 5000) for k in range(20_000))
    rows = [(1, long, long[::-1]), (2, long, "xyz" * 7000), (3, "a b c", "CBAz"), (4, "abc", "abxy"), (5, "", "a"), (6, "ab", "😀"), (7, "😀ab", "ba😀c"), (8, None, "a")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    began = time.time()
    got = {r.i: r.f for r in df.select("i", T.fuzzy_match(F.col("a"), F.col("b")).alias("f")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True, 8: False}
    assert time.time() - began < 20


def test_lines_behind_the_leading_ones_are_not_compared(spark):
    from leafmill.operators import clean

    lines = [(1, k, x) for k, x in enumerate(["", "　", "T1 title", " T1 title!", "T1 title", "T1 title", "T1 title", "end"])] + [(2, 0, "\t"), (2, 1, "other"), (2, 2, "T1 title"), (3, 0, " ")]
    df = clean.trim_leading(spark.createDataFrame(lines, "doc_id long, pos int, line string"), spark.createDataFrame([(1, "T1 title"), (2, "T1 title")], "doc_id long, title string"))
    assert sorted((r.doc_id, r.pos) for r in df.collect()) == [(1, 5), (1, 6), (1, 7), (2, 1), (2, 2)]
    plan = optimized(df)  # lines are spread by document and counted before they meet the titles
    assert plan.index("Join") < plan.rindex("Window")


def test_subtree_totals_read_the_nodes_once(spark, tmp_path):
    from leafmill.operators import detect
    from leafmill.sources import pages as S

    html = "<div id=a>12<a>345</a><p hidden>67<b>8</b></p></div><p>9</p>"
    rows = [(k, f"http://x.example/{k}", html) for k in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    pages = S.read_pages(spark, str(tmp_path))
    assert "RepartitionByExpression" in optimized(pages)
    totals = detect.subtree_totals(S.html_nodes(pages))
    assert optimized(totals).count("MapInArrow") == 1 and "Join" not in optimized(totals)
    got = {(r.tag, r.text_len, r.link_text, r.links, r.breaks, r.shown) for r in totals.where("page_id = 7").collect()}
    assert got == {("div", 8, 3, 1, 1, True), ("a", 3, 3, 1, 0, True), ("p", 3, 0, 0, 1, False), ("b", 1, 0, 0, 0, False), ("p", 1, 0, 0, 1, True)}
    assert optimized(detect.content_elements(S.html_nodes(pages))).count("MapInArrow") == 1
    assert optimized(detect.known_content(S.html_nodes(pages))).count("MapInArrow") == 1


def test_documents_are_spread_before_their_texts_are_searched(spark, tmp_path):
    from leafmill.plans import text_queries

    spark.createDataFrame([(k, "(a) www.x.com") for k in range(20)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = text_queries.QUERIES["clean_text"](spark, str(tmp_path))
    assert "RepartitionByExpression" in optimized(df) and df.count() == 20


def test_white_space_within_texts_is_passed_once(spark):
    import time

    from leafmill.functions import text as T

    gap = "  \u3000\t" * 50_000
    rows = [(1, f"a{gap}b"), (2, f"{gap}a b{gap}"), (3, gap), (4, ""), (5, None), (6, "x \u0085"), (7, "\n a \n\n"), (8, "a \u200b ")]
    df = spark.createDataFrame(rows, "i int, s string")
    began = time.time()
    got = {r.i: r.t for r in df.select("i", T.trim(F.col("s")).alias("t")).collect()}
    assert got == {1: f"a{gap}b", 2: "a b", 3: "", 4: "", 5: None, 6: "x\u0085", 7: "a", 8: "a \u200b"}
    assert time.time() - began < 20
    every = spark.range(0x3100).union(spark.range(0xFE00, 0xFFFE)).select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    assert every.where(F.rlike("c", F.lit(f"^{T.SPACE}$")) != F.rlike("c", F.lit(f"^{T.WHITE}$"))).count() == 0


def test_cleaning_reads_its_steps_once(spark):
    from leafmill.operators import clean
    from leafmill.sources import pages as S

    html = "<div><a>加入书签</a><p>Title</p>one 天天看小说 ttks.tw<br>two<ul><li>x</ul></div>\n"
    pages = spark.createDataFrame([(k, html) for k in range(3)], "page_id long, html string")
    titles = spark.createDataFrame([(1, "Title")], "page_id long, title string")
    df = clean.clean_content(S.html_nodes(pages), titles, [("two", "2 < 3", "")])
    assert {r.page_id: r.content for r in df.collect()} == {k: ("" if k == 1 else "<p>Title</p>") + "<p>one</p><p>2 &lt; 3</p><li>x</li>" for k in range(3)}
    plan = optimized(df)
    assert plan.count("Relation ") == 1 and "MapInArrow" not in plan


def test_navigation_reads_the_links_once(spark):
    from leafmill.operators import detect

    html = "<a href='/b/1/3.html'>下一章</a><a href='/b/1/1.html' rel=prev>back</a><a href='/b/1/'>目录</a><a href='/b/9/x.html'>other</a>"
    df = detect.detect_navigation(spark.createDataFrame([(1, "https://x.example.com/b/1/2.html", html.replace("=prev", "='prev'"))], "page_id long, url string, html string"))
    assert {r.purpose: r.url for r in df.collect()} == {"next": "https://x.example.com/b/1/3.html", "prev": "https://x.example.com/b/1/1.html", "index": "https://x.example.com/b/1/"}
    assert "Union" not in optimized(df)


def test_locked_pages_are_worded_once(spark):
    from leafmill.operators import classify

    texts = ["<body>本章 为 VIP 章节", "<body>已付费的章节内容", "<body>立即，购买", "<body><a>立即订阅</a> vip", "<body>chapter", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, html string").select("i", classify.is_locked().alias("l"))
    assert {r.i: r.l for r in df.collect()} == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False}
    assert optimized(df).count("<body") <= 2


def test_chapters_are_shuffled_once_for_a_write(spark, tmp_path, monkeypatch):
    from leafmill.operators import store

    made = []
    plain = store.ChapterStore._replace
    monkeypatch.setattr(store.ChapterStore, "_replace", lambda self, make, *a: plain(self, lambda old: made.append(make(old)) or made[-1], *a))
    held = store.ChapterStore(spark, f"file://{tmp_path}/s", buckets=3)
    rows = lambda n, c: spark.range(n).selectExpr("cast(id % 7 as string) as book_id", "cast(id % 50 as string) as url", f"concat('{c}', id) as content", "timestamp_seconds(id % 2) as cached_at")
    held.write(rows(200, "a"))
    held.write(rows(100, "b"))
    held.remove(spark.range(7).selectExpr("cast(id as string) as book_id", "'3' as url"))
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= (2 if "LeftAnti" in plan else 1) and "rebalance" not in plan.lower()
    got = {(r.book_id, r.url): r.content for r in held.read().collect()}
    want = {}
    for c, n in (("a", 200), ("b", 100)):
        for i in range(n):
            key, x = (str(i % 7), str(i % 50)), (i % 2, c, f"{c}{i}")
            want[key] = max(want.get(key, x), x)
    assert got == {k: x[2] for k, x in want.items() if k[1] != "3"}
