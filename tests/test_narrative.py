"""Summaries and timelines."""

from warnloom.operators import narrative


def words(n, end="."):
    return " ".join(["word"] * n) + end


def summary(report, text):
    return narrative.summarize(report(text)).first().summary


def timeline(report, text, **options):
    events = narrative.extract_timeline(report(text), **options).first().timeline
    return [(e.date, e.event) for e in events]


def test_short_texts_stay_whole(spark, report):
    assert summary(report, "Hi. A.\nB! C?") == "Hi. A. B! C?"
    assert summary(report, "") == ""


def test_sentence_length_limits(spark, report):
    text = " ".join([words(4), words(5), words(60), words(61), words(3), "ransomware " + words(3)])
    scored = narrative.score_sentences(report(text)).orderBy("sent_idx").collect()
    assert [(r.sent_idx, r.words) for r in scored] == [(1, 5), (2, 60)]
    assert summary(report, text) == words(5) + " " + words(60)
    assert summary(report, " ".join([words(2)] * 6)) == ""


def test_scores_and_ties_prefer_the_later_sentence(spark, report):
    plain = [f"sentence number {i} has six words." for i in range(10)]
    plain[5] = "the malware exploit was a trojan."
    scored = {r.sent_idx: r for r in narrative.score_sentences(report(" ".join(plain))).collect()}
    assert scored[5].hits == 3 and scored[5].score == 3 / 6 * 100 * 1.0
    early = "malware on host number one is here."
    scored = {r.sent_idx: r.score for r in narrative.score_sentences(report(" ".join([early] * 8))).collect()}
    assert scored == {i: 1 / 7 * 100 * (1.5 if i < 3 else 1.2 if i > 4 else 1.0) for i in range(8)}
    # Nothing scores: the four last sentences win, in text order.
    quiet = [f"sentence number {i} has six words." for i in range(10)]
    assert summary(report, " ".join(quiet)) == " ".join(quiet[6:])


def test_date_shapes(spark, report):
    text = (
        "A 3 march 2024 x. B March 3 2024 x. C MARCH 13,  2024 x. D 2024-03-01 x. E 1/2/24 and 01/02/2024 x. "
        "F March 2024 x. G 2024 x. H 12024-03-01 x. I é2024-03-01 x. J 2024-03-01 again 2024-03-01 x."
    )
    rows = narrative.date_mentions(report(text)).orderBy("sent_idx", "pos").collect()
    assert [(r.sent_idx, r.pos, r.date) for r in rows] == [
        (0, 0, "3 march 2024"), (1, 0, "March 3 2024"), (2, 0, "MARCH 13,  2024"), (3, 0, "2024-03-01"),
        (4, 0, "1/2/24"), (4, 1, "01/02/2024"), (9, 0, "2024-03-01"),
    ]
    assert rows[0].event == "A 3 march 2024 x."


def test_yearless_dates_only_where_no_full_date(spark, report):
    text = "On March 13 it began. On March 14, 2026 and March 15 it ended. Nothing in May."
    assert [d for d, _ in timeline(report, text)] == ["March 14, 2026"]
    assert [d for d, _ in timeline(report, text, yearless=True)] == ["March 13", "March 14, 2026"]


def test_event_truncation(spark, report):
    exact = "2024-01-01 " + "x" * 209
    longer = "2024-01-02 " + "x" * 210
    assert len(exact) == 220
    assert timeline(report, exact) == [("2024-01-01", exact)]
    assert timeline(report, longer) == [("2024-01-02", longer[:217] + "...")]


def test_repeats_are_dropped_by_date_and_start(spark, report):
    start = "On 2024-01-01 " + "y" * 60
    text = f"{start} one. {start.upper()} two. On 2024-01-01 else. {start} one."
    assert [e for _, e in timeline(report, text)] == [f"{start} one.", "On 2024-01-01 else."]


def test_cap_ends_with_a_sentence(spark, report):
    seven = " ".join(f"Day 2024-01-0{i} came." for i in range(1, 8))
    text = seven + " Both 2024-02-01 and 2024-02-02 came. Then 2024-03-01 came."
    assert [d for d, _ in timeline(report, text)] == [
        *(f"2024-01-0{i}" for i in range(1, 8)), "2024-02-01", "2024-02-02",
    ]
    assert len(timeline(report, text, max_events=7)) == 7
    assert len(timeline(report, text, max_events=100)) == 10


def test_a_report_with_very_many_dates(spark, report):
    text = " ".join(f"Entry {i} of 2024-01-01 logged." for i in range(40_000))
    assert len(timeline(report, text)) == 8
    assert narrative.dedupe_events(report(text)).count() == 40_000
