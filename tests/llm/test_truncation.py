from __future__ import annotations

import random

from plumbline.llm.truncation import ends_in_form, truncated_texts, truncation_report

WORDS = ("the lantern stopped near the vineyard", "nobody followed the captain yesterday", "we counted every letter tonight", "hide the kettle under the harbour")


def text(rnd, cues, style="{}."):
    return "\n\n".join(f"{k}\n00:00:{k % 60:02d},000 --> 00:00:{k % 60:02d},900\n{style.format(rnd.choice(WORDS))}" for k in range(1, cues + 1))


def test_form():
    whole = "1\n00:00:01,000 --> 00:00:02,000\n<i>All of them?</i>"
    assert not ends_in_form(whole) and not ends_in_form("a line without end") and not ends_in_form("1\n00:00:01,000 --> 00:00:02,000\n42 of them")
    for tail in ("\n\n2", "\n\n2\n0", "\n\n2\n00:00:0", "\n\n2\n00:00:03,000 -->", "\n\n2\n00:00:03,000 --> 00:00:04,000", "\n\n2\n00:00:03,000 --> 00:00:04,000\n[door cre", "\n\n2\n00:00:03,000 --> 00:00:04,000\n<i>No", "\n\n2\n00:00:03,000 --> 00:00:04,000\n-"):
        assert ends_in_form(whole + tail), tail


def test_evidence(spark):
    rnd = random.Random(1)
    rows = [(k, "free", text(rnd, rnd.randint(3, 30), "{}." if k % 4 else "{}")) for k in range(300)]
    rows += [(1000 + k, "limited", text(rnd, 40)[:1000]) for k in range(40)]
    rows += [(2000 + k, "limited", text(rnd, rnd.randint(2, 12))[:1000]) for k in range(200)]
    limit = next(t for k, s, t in rows if k == 1000)
    head = text(rnd, 9) + "\n\n10\n00:00:10,000 --> 00:00:10,900\n"
    cases = {
        5001: ("nobody followed the capt", True), 5002: ("we counted every", True), 5003: ("hide the kettle under the h", True), 5004: ("we counted every letter tonight", False), 5005: ("nobody followed the captain yesterday.", False),
    }
    rows += [(k, "free", head + t) for k, (t, _) in cases.items()]
    rows += [(6000, "other", limit), (6001, None, text(rnd, 5)), (6002, "free", None), (6003, "free", ""), (6004, "free", " \n\n "), (6005, "free", head + "we counted every letter tonight.\n\n\n"), (None, "free", "x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, source string, text string, hash string")
    got = {r["doc_id"]: r["truncated"] for r in truncated_texts(df).collect()}
    assert {k: got[k] for k in cases} == {k: v for k, (_, v) in cases.items()}
    assert all(got[1000 + k] for k in range(40)) and got[6000] and not got[6005] and not got[6001]
    assert not {6002, 6003, 6004, None} & set(got) and not any(got[k] for k in range(300))
    wrong = [k for k in range(2000, 2200) if got[k]]
    size = {r[0]: len(r[2] or "") for r in rows}
    assert all(size[k] >= 997 for k in wrong), [size[k] for k in wrong]
    report = {r["source"]: r for r in truncation_report(df).collect()}
    assert report["other"]["share"] == 1.0 and report[None]["truncated"] == 0


def test_tokens_longer_than_the_trie(spark):
    """Scripts without spaces and compounds give tokens of any length."""
    rnd = random.Random(3)
    known = "".join(rnd.choice("abcdefgh") for _ in range(90))
    whole = lambda w: f"1\n00:00:01,000 --> 00:00:01,900\nwe saw {w} again.\n\n2\n00:00:02,000 --> 00:00:02,900\nnobody saw {w}."
    rows = [(k, "s", whole(known)) for k in range(6)]
    cut = {10: known[:60], 11: known[:41], 12: known[:39], 13: known[:60] + "x", 14: known}
    rows += [(k, "t", f"1\n00:00:01,000 --> 00:00:01,900\nwe saw {w}") for k, w in cut.items()]
    got = {r["doc_id"]: r["truncated"] for r in truncated_texts(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert [got[k] for k in cut] == [True, True, True, False, False] and not any(got[k] for k in range(6))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert truncated_texts(df).count() == 0 and truncation_report(df).count() == 0
