"""Main texts of generated pages whose article is known, column names that clash, and scratch tables of other threads."""

import random
import threading

import corpus_pipeline
from pyspark.sql import functions as F
from skein.llm import common, decontamination, html_text, media, minhash, packing, secrets, toxicity

LONG = "This sentence is long enough, with commas and words, to pass for a paragraph of an article by itself, and goes on"


def test_foreign_parts_go_however_long_and_wherever_they_stand():
    two = f"<p>{LONG} one.</p><p>{LONG} two.</p>"
    body = f"<p>{LONG}.</p><p>{LONG} again.</p>"
    want = f"{LONG}.\n{LONG} again."
    for page in (
        f"<article>{body}<section class='comments'>{two}{two}{two}</section></article>",
        f"<main><article>{body}</article><div id='comments'>{two}{two}{two}</div></main>",
        f"<article>{body}<div class='ad'><p>{LONG} buy.</p></div></article>",
        f"<article><div class='notice'><p>{LONG} cookies.</p></div>{body}</article>",
        f"<div>{body}</div><div class='comment-list'>{two}{two}</div>",
        f"<main>{body}<ol class='comments'><li><article class='comment-body'>{two}</article></ol></main>",
        f"<article>{body}<div class='newsletter-signup'>{LONG}</div><div id='disqus_thread'>{two}</div><p class='sponsored'>{LONG}</p></article>",
        f"<div class='cookie-notice'>{two}</div><article>{body}</article><div class='sponsored'><article>{two}</article></div>",
    ):
        assert html_text.main_text(page) == want, page


def test_names_that_sound_alike_and_the_only_text_stay():
    for name in ("commentary", "addendum", "adventure", "noticeboard-news", "commentator", "adder", "cookie-recipe"):
        assert html_text.main_text(f"<article><p>{LONG}.</p><div class='{name}'><p>{LONG} more.</p></div></article>") == f"{LONG}.\n{LONG} more."
    assert html_text.main_text(f"<div class='notice'><p>{LONG}.</p></div>") == f"{LONG}."
    assert html_text.main_text(f"<h1>Head</h1><div class='sponsored'><article><p>{LONG}.</p></article></div>") == f"{LONG}."
    assert "# a note" in html_text.main_text(f"<article><p>{LONG}.</p><pre>x = 1 <span class='comment'># a note</span></pre></article>")
    assert html_text.main_text("<div class='ad'>x</div>") == "x"


def generated(r: random.Random) -> tuple[str, str]:
    """A page and its main text: an article in one of several frames, side matters of any length around and inside it."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    prose = lambda n: ", ".join(" ".join(word() for _ in range(8)) for _ in range(n)) + "."
    links = lambda: "<ul>" + "".join(f"<li><a href='/{word()}'>{word()} {word()}</a></li>" for _ in range(r.randint(2, 9))) + "</ul>"
    foreign = lambda: f"<{(tag := r.choice(['div', 'section']))} class='{r.choice(['comments', 'comment-list', 'ad', 'advert', 'ad-slot', 'cookie-notice', 'newsletter', 'sponsored', 'user-comments'])}'>" + "".join(f"<p>{prose(r.randint(1, 12))}</p>" for _ in range(r.randint(1, 5))) + f"</{tag}>"
    menu = lambda: r.choice([f"<nav>{links()}</nav>", f"<aside><p>{prose(3)}</p>{links()}</aside>", f"<div class='menu'>{links()}</div>", f"<form><p>{prose(2)}</p><input></form>", f"<script>var x = '<p>{word()}</p>';</script>", f"<footer>{prose(2)}</footer>"])
    lines, inner = [prose(r.randint(4, 9)) for _ in range(r.randint(3, 7))], ""
    for line in lines:
        inner += f"<p>{line}</p>" + foreign() * (r.random() < 0.2) + menu() * (r.random() < 0.1)
    frame = r.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article>{}</main>", "<div><div class='post'>{}</div></div>"])
    page = frame.format(inner, foreign()) if frame.count("{}") == 2 else frame.format(inner)
    page = "".join(r.choice([menu, foreign])() for _ in range(r.randint(0, 3))) + page + "".join(r.choice([menu, foreign])() for _ in range(r.randint(0, 3)))
    return f"<html><head><title>{word()}</title></head><body>{page}</body></html>", "\n".join(lines)


def test_generated_pages_give_their_article():
    r = random.Random(12)
    for _ in range(400):
        page, want = generated(r)
        assert html_text.main_text(page) == want, page


def test_pages_repeat_and_tables_may_be_empty(spark):
    page, want = generated(random.Random(3))
    pages = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).orderBy("page_id").collect()] == [(None, "", 0)] + [(1, want, len(want))] * 2
    assert html_text.extract(pages.limit(0)).count() == 0


ODD = "doc_id long, text string, lang string, `a.b` int, _row long, `back``tick` int, score double, spans string"
ROWS = [(1, "the password = hunter2hunter2 is here", "en", 7, 77, 5, 0.5, "s"), (2, "one two three four five six seven", "en", 8, 78, 6, 0.5, "s"), (2, "one two three four five six seven", "en", 8, 78, 6, 0.5, "s"), (None, None, None, 9, 79, 7, None, None)]


def test_columns_of_any_name_are_carried(spark):
    docs = spark.createDataFrame(ROWS, ODD)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["_row"] for r in kept.collect()) == [77, 78, 79]
    red = secrets.redact(docs)
    assert red.columns == docs.columns and sorted(tuple(r)[3:] for r in red.collect() if r.doc_id == 1) == [ROWS[0][3:]]
    assert [r.text for r in red.collect() if r.doc_id == 1] == ["the [SECRET] is here"]
    stay = toxicity.drop_toxic(docs, labels)
    assert stay.columns == docs.columns and all(tuple(r)[3:] in {x[3:] for x in ROWS} for r in stay.collect())


def test_each_operator_takes_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame(ROWS, ODD)
    sniffed = lambda d: media.sniff_media(d.withColumn("content", F.coalesce("text", F.lit("")).cast("binary")), "doc_id", "content")
    assert sniffed(docs.limit(0)).count() == 0 == sniffed(docs).count()
    items = spark.createDataFrame([(1, ROWS[1][1]), (1, ROWS[1][1]), (2, None), (None, "")], "item_id long, text string")
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0 == decontamination.contaminated(docs.limit(0), items).count()
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()} == {(2, 1)}
    assert decontamination.drop_contaminated(docs, items.limit(0)).count() == 4
    assert sorted(r["_row"] for r in decontamination.drop_contaminated(docs, items).collect()) == [77, 79]
    assert packing.pack_documents(docs.limit(0)).count() == 0
    model = toxicity.train([("bad words", 1), ("good words", 0)])
    scores = toxicity.scored(docs, model).collect()
    assert len(scores) == 4 and toxicity.scored(docs.limit(0), model).count() == 0
    assert len({r.score for r in scores if r.row.doc_id == 2}) == 1


def test_scratch_of_another_thread_stays(spark):
    held, go, done = [], threading.Event(), threading.Event()

    def other():
        with common.scratch(spark) as kept:
            held.append(common.materialize(spark.range(5).toDF("x"), "other"))
            go.set()
            done.wait(60)
            kept.append(held[0])

    t = threading.Thread(target=other)
    t.start()
    go.wait(60)
    with common.scratch(spark) as kept:
        mine, gone = common.materialize(spark.range(3).toDF("x"), "mine"), common.materialize(spark.range(2).toDF("x"), "gone")
        kept.append(mine)
    assert mine.count() == 3 and held[0].count() == 5
    try:
        gone.count()
        raise AssertionError("the table is still there")
    except Exception as e:
        assert "still there" not in str(e)
    done.set()
    t.join()
    assert held[0].count() == 5
    assert spark.conf.get(common.CLEAN_UP, "false") == "false"
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
