import json
import math
import re

import pytest
from pyspark.sql import functions as F

from titlelink.errors import BadDigest, BadJson, BadPage, Cancelled, CatalogIo, EmptyCatalog, NotLoaded, OutOfIndex, PrivateList, SourceRejected, StaleVersion
from titlelink.functions import text as X
from titlelink.operators import match, merge, review, score, search
from titlelink.plans.engine import Cell, Engine
from titlelink.sinks import export
from titlelink.sources import catalog, lists, pages


def entry(i, title, **more):
    base = {"sources": ["https://other.site/anime/1", f"https://myanimelist.net/anime/{i}"], "title": title, "type": "TV", "episodes": 12, "status": "FINISHED", "animeSeason": {"season": "SPRING", "year": 2020},
            "picture": "p", "thumbnail": "t", "duration": {"value": 1440}, "synonyms": [], "studios": [], "producers": [], "relatedAnime": [], "tags": []}
    return json.dumps(base | more)


@pytest.fixture(scope="module")
def catalog_file(tmp_path_factory):
    lines = [
        json.dumps({"lastUpdate": "2026-06-06"}), entry(5, "Cowboy Story"), entry(5, "Cowboy Tale", synonyms=["Kauboi Tale 2nd Season"]), entry(9, "Space Opera Season 2", animeSeason={"season": "UNDEFINED"}, duration=None),
        entry(7, "No Link", sources=["https://other.site/anime/7"]), "", entry(11, "日本語", synonyms=["Nihon Drama"], type="MOVIE"), entry(12, "Cowboy Tale Extra", type="OVA"),
    ]
    path = tmp_path_factory.mktemp("c") / "catalog.jsonl"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def source(spark, rows):
    """(pos, title, mal_id)"""
    df = spark.createDataFrame([(p, p, t, m) for p, t, m in rows], "list_pos long, id long, title string, mal_id long")
    extra = {"provider": F.lit("a"), "has_date": F.lit(True), "date": F.lit("2020-04-01").cast("date"), "has_year": F.lit(True), "year": F.lit(2020), "has_type": F.lit(True), "anime_type": F.lit("Tv"),
             "has_status": F.lit(True), "status": F.lit("Finished"), "has_episodes": F.lit(True), "episodes": F.lit(12), "watch_status": F.lit("OnHold"), "watched_episodes": F.lit(3), "score": F.lit(7),
             "finish_date": F.lit(None).cast("date"), "note": F.lit("a & b")}
    from titlelink.functions.text import normalize_title
    from titlelink.functions.titles import title_meta

    return df.withColumns(extra).withColumn("norm_title", normalize_title("title")).withColumn("meta", title_meta("norm_title"))


def test_catalog(spark, catalog_file):
    rows = {r.id: r for r in catalog.load(spark, catalog_file).collect()}
    assert sorted(rows) == [5, 9, 11, 12]
    assert rows[5].title == "Cowboy Tale" and rows[5].norm_synonyms == ["kauboi tale 2nd season"] and rows[5].cons.season == 2.0
    assert rows[9].season == "Undefined" and rows[9].year is None and rows[9].duration_s is None and rows[9].cons.season == 2.0
    assert rows[11].norm_title == "" and rows[11].anime_type == "Movie"


def test_catalog_errors(spark, tmp_path):
    empty, bad, enum = tmp_path / "e", tmp_path / "b", tmp_path / "n"
    empty.write_text("")
    bad.write_text("not json\n")
    enum.write_text(json.dumps({"lastUpdate": "2026-06-06"}) + "\n" + entry(1, "x", type="RADIO"))
    with pytest.raises(EmptyCatalog):
        catalog.header(spark, str(empty))
    with pytest.raises(BadJson):
        catalog.header(spark, str(bad))
    with pytest.raises(Exception, match="unknown"):
        catalog.check_enums(catalog.load(spark, str(enum)))


def grams(t):
    p = f"^^{t}$$"
    return list(dict.fromkeys(p[k : k + 3] for k in range(len(p) - 2)))


def model(docs, queries, limit, threshold, strict):
    """The search, plainly: docs (canonical, alias, text)."""
    post = {}
    for c, a, t in docs:
        for g in grams(t):
            post.setdefault(g, []).append((c, a))
    sizes, n, out = {(c, a): len(grams(t)) for c, a, t in docs}, len(docs), {}
    for q, t in queries:
        known = [g for g in grams(t) if g in post]
        terms = sorted((g for g in known if len(post[g]) < math.floor(0.2 * n)), key=lambda g: len(post[g]))
        if not terms:
            continue
        seeds = set().union(*(post[g] for g in terms[: 1 + min(max(len(terms) // 3, 1), 4)]))
        if strict and (whole := set(post[terms[0]]).intersection(*(post[g] for g in terms))):
            seeds = whole
        best = {}
        for d in seeds:
            m = sum(d in post[g] for g in terms)
            s = min(1.0, 0.8 * m / len(known) + 0.2 * m / (len(known) + sizes[d] - m))
            if s >= threshold:
                best[d[0]] = max(best.get(d[0], 0), s)
        out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:limit]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("strict", [False, True])
def test_search_against_model(spark, strict):
    words = "cowboy space opera tale night river stone garden winter moon".split()
    docs = [(k, f"{words[k % 10]} {words[(k * 7 + 3) % 10]} {k % 4}", f"{words[(k * 3) % 10]}{k}") for k in range(60)]
    entries = spark.createDataFrame([(k, a, [b]) for k, a, b in docs], "id long, norm_title string, norm_synonyms array<string>")
    queries = [(0, "cowboy tale 1"), (1, "garden winter"), (2, ""), (3, "zzz"), (4, "space opera night 2"), (5, "stone1")]
    flat = [(k, 0, a) for k, a, _ in docs] + [(k, 1, b) for k, _, b in docs]
    got = search.search(spark.createDataFrame(queries, "q long, text string"), search.build(entries), search.Options(8, 0.3, strict)).orderBy("q", "search_rank").collect()
    mine = {}
    for r in got:
        mine.setdefault(r.q, []).append((r.id, round(r.search_score, 9)))
    assert mine == {q: [(i, round(s, 9)) for i, s in v] for q, v in model(flat, queries, 8, 0.3, strict).items()}


def test_weights():
    assert [round(w, 6) for w in score.STRICT.weights] == [0.226164, 0.075579, 0.19033, 0.178726, 0.139329, 0.083257, 0.106616]
    assert score.weights([0, 0], 1) == [0.5, 0.5]
    with pytest.raises(ValueError):
        score.masked_weights([1.0], [])


def test_scores(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    lit, date = F.lit, lambda s: F.lit(s).cast("date")
    assert [one(score.year_score(lit(2020), lit(y), 2026)) for y in (2020, 2021, 2018, 2000)] == [1.0, 0.35, -0.1, -0.35]
    assert one(score.year_score(lit(None).cast("int"), lit(2025), 2026)) == 0.46 and one(score.year_score(lit(None).cast("int"), lit(None).cast("int"), 2026)) == 0.7
    assert one(score.type_score(lit("Ova"), lit("Special"))) == 0.6 and one(score.type_score(lit("Tv"), lit("Movie"))) == 0.2
    assert round(one(score.episodes_score(lit(12), lit(24))), 6) == 0.450625 and one(score.episodes_score(lit(0), lit(12))) == 0.7
    assert [one(score.seasonal_score(date(d), lit(s))) for d, s in (("2020-04-01", "Spring"), ("2020-06-01", "Spring"), ("2020-04-01", "Undefined"))] == [1.0, 0.75, 0.4]
    assert one(score.seasonal_score(lit(None).cast("date"), lit("Undefined"))) == 0.7
    assert one(score.status_score(lit("Unknown"), lit("Unknown"))) == 0.7


def test_winner_rules(spark):
    rows = [(1, 10, 1, 0.9), (1, 11, 2, 0.85), (2, 12, 1, 0.9), (2, 13, 2, 0.6), (3, 12, 1, 0.95), (4, 14, 1, 0.5)]
    df = spark.createDataFrame(rows, "q long, id long, search_rank int, final_score double")
    chosen = match.choose(df, score.Preset((1.0,), 0.7, 0.075))
    assert {(r.q, r.id) for r in chosen.where("is_winner").collect()} == {(2, 12), (3, 12)}
    assert {(r.q, r.id) for r in match.finalize(chosen).where("is_winner").collect()} == {(3, 12)}


def test_engine(spark, catalog_file, tmp_path):
    engine = Engine(spark, 2026)
    with pytest.raises(NotLoaded):
        engine.catalog_ids()
    assert engine.catalog_metadata(catalog_file) == {"last_update": "2026-06-06"} and engine.load_catalog(catalog_file) == 1
    engine.use_source(source(spark, [(0, "Cowboy Tale", None), (1, "Nihon Drama", None), (2, "whatever", 9), (3, "Space Opera 2", 10**7)]))
    got = {r.q: r for r in match.nested(engine.match_source_list(threshold=0.01), engine.source.load().value).collect()}
    assert got[2].winner == 9 and len(got) == 4
    assert [r.id for r in engine.catalog_entries([12, 5, 99]).collect()] == [12, 5] and [r.id for r in engine.catalog_ids().collect()] == [5, 9, 11, 12]
    assert engine.fuzzy_match("Space Opera", None, threshold=0.01).count() >= 0 and engine.fuzzy_match("Space Opera", 3, threshold=0.01).count() >= 0
    out = tmp_path / "list.xml"
    pairs = spark.createDataFrame([(0, 1, 5), (1, 0, 9)], "pair_pos long, source_id long, catalog_id long")
    assert engine.export_xml(pairs, str(out)) == 2
    text = out.read_text()
    assert re.findall(r"<series_animedb_id>(\d+)<", text) == ["5", "9"] and "<my_status>On-Hold</my_status>" in text and "a &amp; b" in text and "0000-00-00" in text
    with pytest.raises(OutOfIndex):
        engine.export_xml(spark.createDataFrame([(0, 77, 5)], "pair_pos long, source_id long, catalog_id long"), str(tmp_path / "none.xml"))
    assert not (tmp_path / "none.xml").exists()
    with pytest.raises(StaleVersion):
        engine.check_versions(catalog=0)


def test_cell():
    cell = Cell("x")
    assert cell.store(1) == 1 and cell.load().value == 1
    with pytest.raises(StaleVersion):
        cell.store(2, expected=0)
    cell.clear(expected=1)
    with pytest.raises(NotLoaded):
        cell.load()


def test_merges(spark):
    df = spark.createDataFrame([(1, 0, 1, "a", None), (1, 1, 3, None, "x"), (1, 2, 2, "b", "y"), (2, 3, 1, None, "z")], "id long, pos long, rank int, f string, g string")
    got = {r.id: (r.f, r.g, r.pos) for r in merge.by_precedence(df, "id", "pos", "rank", ["f", "g"]).collect()}
    assert got == {1: ("b", "x", 1), 2: (None, "z", 3)}
    assert [(r.id, r.f, r.g) for r in merge.first_then_fill(df, "id", "pos", ["f", "g"]).collect()] == [(1, "a", "x"), (2, None, "z")]
    assert [(r.id, r.pos) for r in merge.last_wins(df, "id", "pos").collect()] == [(1, 2), (2, 3)]
    assert {r.pos: r.batch_id for r in merge.batches(df, "pos", 2, 3).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}


def test_source_a(spark, tmp_path):
    item = {"titleId": 3, "watchStatus": "skip", "isFavourite": 2, "title": "T 2", "premiereDate": 82800, "finishDate": None, "titleStatus": "Proposal", "animeType": "Music", "watchedEpisodesCnt": "12", "episodes": None}
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"success": True, "message": "", "result": {"items": [item, item | {"title": "T 3"}]}}))
    row = lists.a_list(lists.a_items(spark, str(path))).collect()
    assert len(row) == 1 and (row[0].title, row[0].watch_status, row[0].anime_type, row[0].status, str(row[0].date), row[0].episodes, row[0].watched_episodes) == ("T 3", "Dropped", "Ova", "Upcoming", "1970-01-02", 0, 12)
    path.write_text(json.dumps({"success": 0, "message": "no such user"}))
    with pytest.raises(SourceRejected, match="no such user"):
        lists.a_items(spark, str(path))


B_CARD = '<div class="categories"><div class="title"><p class="label"><a href="/anime/{s}">{t}</a></p></div><p class="info">Status: Emitowane Ocena {r}/10</p></div>'


def test_source_b(spark):
    page = lambda *cards: '<div class="user-activity">' + "".join(B_CARD.format(s=s, t=t, r=r) for s, t, r in cards) + "</div>"
    rows = spark.createDataFrame([("plans", 2, 1, page(("x", "X", 3), ("y", "Y", 4))), ("rated", 0, 1, page(("x", "X!", 8)))], "section string, section_pos int, page int, html string")
    detail = '<a class="mal-link" href="https://myanimelist.net/anime/42/x">m</a><table><tr><td>Rok produkcji</td><td>2010</td></tr><tr><td>Rodzaj</td><td>TV</td></tr><tr><td>1</td><td><a href="/odcinek/0">x</a></td></tr></table><table class="episodes"><tbody><tr><td>1</td><td><a href="/odcinek/1">o</a></td></tr><tr><td>2</td></tr></tbody></table>'
    got = {r.title: r for r in lists.b_list(rows, spark.createDataFrame([("x", detail)], "slug string, html string")).collect()}
    assert set(got) == {"X!", "Y"}
    x = got["X!"]
    assert (x.mal_id, x.year, x.anime_type, x.episodes, x.watch_status, x.watched_episodes, x.score, x.status, x.has_date) == (42, 2010, "Tv", 1, "Completed", 1, 8, "Ongoing", False)
    assert got["Y"].mal_id is None and not got["Y"].has_type and got["Y"].watch_status == "PlanToWatch"


def test_source_c(spark):
    row = '<tr id="anime_list_item_{i}"><td>1</td><td><img></td><td><a href="/anime/s{i}">{t}</a></td><td>{s}</td><td>{r}</td><td><span>238</span> / <span>238</span> odc.</td><td>ONA</td></tr>'
    html = '<table id="my_anime_table"><tbody>' + row.format(i=7, t="D D", s="Nie oglądam", r="") + row.format(i=8, t="E", s="Obejrzane", r="9") + "</tbody></table>"
    detail = '<div class="outlines"><span class="btn-outline-warning">ONA</span></div><span class="badge">TV</span><p class="m-0">Odcinki: 52 odc.</p><p class="m-0">Status: Zakończone</p><p class="m-0">Start emisji: 2018-01-20</p>'
    tip = json.dumps({"data": '<div><h5>E | 別</h5><span class="badge badge-warning">ONA</span><small class="text-trim">E 2nd Season | 斗罗大陆 第二季</small><p><i class="fa fa-play"></i> 238 odc.</p><small>Status: Emitowane</small><small>Koniec emisji: 2020-02-03</small></div>'})
    got = {r.id: r for r in lists.c_list(spark.createDataFrame([(1, html)], "page int, html string"), spark.createDataFrame([(7, detail)], "id long, html string"), spark.createDataFrame([(8, tip)], "id long, body string")).collect()}
    assert (got[7].episodes, got[7].watched_episodes, got[7].status, str(got[7].date), got[7].watch_status, got[7].score) == (52, 52, "Finished", "2018-01-20", "Dropped", None)
    assert (got[8].episodes, got[8].watch_status, got[8].score, got[8].anime_type) == (238, "Completed", 9, "Ona")
    assert (got[8].status, str(got[8].finish_date), got[7].anime_type) == ("Ongoing", "2020-02-03", "Ona")
    with pytest.raises(PrivateList):
        pages.c_list("x " + pages.PRIVATE)
    read = pages.c_tooltip(tip)
    assert (read["episodes"], read["original_title"], read["badge"]) == (238, "斗罗大陆 第二季", "ONA")


def test_bad_pages():
    rows = lambda row: f'<table id="my_anime_table"><tbody>{row}</tbody></table>'
    cell = "<td>x</td>"
    for bad in (f'<tr id="anime_list_item_1">{cell * 6}</tr>', f'<tr id="anime_list_item_x">{cell * 7}</tr>', f'<tr id="anime_list_item_1">{cell * 7}</tr>', f'<tr id="anime_list_item_1">{cell * 2}<td><a href="/anime/">t</a></td>{cell * 4}</tr>'):
        with pytest.raises(BadPage):
            pages.c_list(rows(bad))
    assert pages.c_list(rows('<tr id="other"></tr>')) == [] and pages.c_list("") == []
    for read, page in ((pages.b_detail, "<table><tr><td>Rodzaj</td><td>TV</td></tr></table>"), (pages.c_detail, '<p class="m-0">Status: Emitowane</p>'), (pages.c_tooltip, json.dumps({"data": "<p>x</p>"})), (pages.c_tooltip, "no json"), (pages.c_tooltip, "{}")):
        with pytest.raises(BadPage):
            read(page)
    assert pages.b_detail("<table><tr><td>Rok produkcji</td><td>2010</td></tr></table>")["cells"] == [{"label": "Rok produkcji", "value": "2010"}]


def test_strict_loads(spark):
    df = spark.createDataFrame([("radio", "x")], "t string, n string")
    for bad in (X.a_type("t"), X.a_status("t"), X.a_watch("t"), X.whole_number("n")):
        with pytest.raises(Exception, match="unknown|not a whole"):
            df.select(bad).collect()
    assert df.select(X.whole_number(F.lit("12")), X.a_type(F.lit(None).cast("string"))).first()[:] == (12, None)


def test_registered(spark):
    from titlelink.functions.register import register

    register(spark)
    assert spark.sql("SELECT normalize_title('  Ā  Ｂ≠シンゲキ K ') AS t").first().t == spark.range(1).select(X.normalize_title(F.lit("  Ā  Ｂ≠シンゲキ K ")).alias("t")).first().t == "a =shingeki k"
    assert spark.sql("SELECT title_metadata('snk season 2 part 3') AS m").first().m[:3] == (2.0, 3.0, None)
    assert [r.gram for r in spark.sql("SELECT gram FROM trigrams('aaaa') ORDER BY pos").collect()] == ["^^a", "^aa", "aaa", "aa$", "a$$"]


def test_paged_list(spark, tmp_path):
    from titlelink.sources.paged import PagedList

    for k in range(3):
        (tmp_path / f"page-2-{2 * k}.json").write_text(json.dumps({"at": k}))
    spark.dataSource.register(PagedList)
    rows = spark.read.format("paged_list").option("url", f"file://{tmp_path}/page-{{limit}}-{{offset}}.json").option("total", 5).option("limit", 2).load()
    assert rows.rdd.getNumPartitions() == 3 and {(r.page, r.offset, json.loads(r.body)["at"]) for r in rows.collect()} == {(0, 0, 0), (1, 2, 1), (2, 4, 2)}


def test_throttle():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    t = lists.Throttle(2, 1, 2, clock=lambda: now[0], sleep=sleep)
    tries = iter([ValueError("first"), "ok", "ok"])

    def fetch():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert t.call(fetch) == "ok" and t.call(fetch) == "ok" and sum(slept) == pytest.approx(1.0)


def review_tables(spark):
    winners = spark.createDataFrame([(1, 1, 10, True), (2, 2, 10, True), (3, 3, None, True), (4, 4, None, False), (5, 5, 11, True), (6, 6, 12, True)], "source_id long, list_pos long, winner_id long, has_top boolean")
    return winners, spark.createDataFrame([(3, 10), (5, 12)], "source_id long, catalog_id long"), spark.createDataFrame([(2,)], "source_id long")


def test_review(spark):
    winners, overrides, ignores = review_tables(spark)
    state = review.effective(winners, overrides, ignores)
    assert {r.source_id: r.effective_id for r in state.collect()} == {1: None, 2: None, 3: 10, 4: None, 5: 12, 6: None}
    labels = {r.source_id: r.l for r in state.select("source_id", review.status_label().alias("l")).collect()}
    assert labels == {1: "suppressed", 2: "ignored", 3: "manual", 4: "unmatched", 5: "manual", 6: "suppressed"}
    assert [r.source_id for r in review.view(state, "all").collect()] == [4, 3, 1, 2, 5, 6]
    one, back = review.set_override(overrides, ignores, winners, 2, 12)
    assert {tuple(r) for r in one.collect()} == {(3, 10), (2, 12)} and back.count() == 0
    same, _ = review.set_override(overrides, ignores, winners, 5, 11)
    assert {tuple(r) for r in same.collect()} == {(3, 10)}
    left, now = review.toggle_ignored(overrides, ignores, 3)
    assert {tuple(r) for r in left.collect()} == {(5, 12)} and {r[0] for r in now.collect()} == {2, 3}
    assert review.clear_override(overrides, 3).count() == 1 and review.clear_override(overrides).count() == 0
    s = review.summary(state).first()
    assert (s.total, s.automatic, s.manual, s.ignored, s.review, s.percentage) == (6, 0, 2, 1, 3, 33)
    both = review.summary(review.effective(winners, overrides, overrides.select("source_id"))).first()  # an ignored row's override still counts as manual
    assert (both.automatic, both.manual, both.ignored, both.review, both.percentage) == (0, 2, 2, 4, 33)
    assert {r.source_id for r in review.view(state, "automatic").collect()} == {1, 2, 5, 6}  # ignored rows stay


def test_review_file(tmp_path):
    path = str(tmp_path / "r.json")
    export.save_review(path, "k", {1: 2}, [3])
    assert export.load_review(path, "k") == ({1: 2}, {3})
    export.save_review(path, "k", {}, [])
    assert export.load_review(path, "k") == ({}, set()) and json.load(open(path)) == {}
    export.write_atomically(path, [json.dumps({"k": {"5": "6", "x": "7"}})])
    assert export.load_review(path, "k")[0] == {5: 6}


def test_stream(spark, tmp_path):
    from titlelink.streaming.incremental import Progress, events, match_stream, read_lists, winners

    entries = spark.createDataFrame([(k, f"title {w}", [f"alias{w}"]) for k, w in enumerate("moon river stone garden winter night opera cowboy".split())], "id long, norm_title string, norm_synonyms array<string>").withColumns({"cons": F.expr("named_struct('season', cast(null as double), 'part', cast(null as double), 'episode', cast(null as double), 'is_final_season', false, 'is_final_part', false, 'is_final_episode', false)"), "year": F.lit(2020), "anime_type": F.lit("Tv"), "status": F.lit("Finished"), "season": F.lit("Spring"), "episodes": F.lit(12)})
    rows = source(spark, [(0, "title moon", None), (1, "title river", None)])
    rows.write.parquet(str(tmp_path / "in"))
    told = []
    progress = Progress(lambda *x: told.append(x))
    progress.start(2)
    q = match_stream(read_lists(spark, str(tmp_path / "in"), rows), entries, search.build(entries), str(tmp_path / "out"), str(tmp_path / "cp"), 2026, search.Options(5, 0.1), progress)
    q.awaitTermination(120)
    assert told == [("list", 0, 2), ("details", 2, 2), ("storing", 2, 2), ("done", 2, 2)]
    assert [(r.phase, r.entries) for r in events(spark, str(tmp_path / "out")).collect()] == [("details", 2), ("storing", 2)]
    progress.cancel()
    with pytest.raises(Cancelled):
        progress.entries()
    assert winners(spark, str(tmp_path / "out")).where("is_winner").select("q", "id").orderBy("q").collect() == [(0, 0), (1, 1)]
    # Rows linked directly keep their entry; what was searched loses only to what was searched.
    scored = spark.createDataFrame([(0, 7, 1.0, True, True), (1, 7, 1.0, True, True), (2, 7, 0.9, True, False), (3, 7, 0.8, True, False)], "q long, id long, final_score double, is_winner boolean, is_direct boolean")
    scored.write.parquet(str(tmp_path / "more"))
    assert {r.q: r.is_winner for r in winners(spark, str(tmp_path / "more")).collect()} == {0: True, 1: True, 2: True, 3: False}


def test_final_episode_needs_an_episode(spark):
    """A candidate's last episode says nothing if the query has none."""
    meta = "named_struct('season', cast(99 as double), 'part', cast(null as double), 'episode', cast({e} as double))"
    cons = "named_struct('season', cast(null as double), 'part', cast(null as double), 'episode', cast(null as double), 'is_final_season', false, 'is_final_part', false, 'is_final_episode', true)"
    got = [spark.range(1).select(F.expr(meta.format(e=e)).alias("m"), F.expr(cons).alias("c")).select(score.season_score(F.col("m"), F.col("c"))).first()[0] for e in ("null", "5")]
    assert got == [0.4, 1.0]


def test_download(spark, catalog_file, tmp_path):
    import hashlib

    import zstandard

    packed = zstandard.ZstdCompressor().compress(open(catalog_file, "rb").read())
    (tmp_path / "c.zst").write_bytes(packed)
    target, digest = str(tmp_path / "c.jsonl"), hashlib.sha256(packed).hexdigest()
    engine = Engine(spark, 2026)
    assert engine.download_catalog(f"file://{tmp_path}/c.zst", target, "r1", digest.upper()) == 1 and engine.catalog_ids().count() > 0
    side = export.read_sidecar(f"{target}.json")
    assert side == {"release": "r1", "sha256": digest, "compressed_size": len(packed)} and not engine.check_catalog_update(side, side) and engine.check_catalog_update(side, side | {"release": "r2"})
    before = open(target).read()
    with pytest.raises(BadDigest):
        engine.download_catalog(f"file://{tmp_path}/c.zst", target, "r2", "0" * 64)
    with pytest.raises(CatalogIo):
        engine.download_catalog(f"file://{tmp_path}/none.zst", target, "r2")
    assert open(target).read() == before and sorted(x.name for x in tmp_path.iterdir()) == ["c.jsonl", "c.jsonl.json", "c.zst"]
