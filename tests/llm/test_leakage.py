from __future__ import annotations

import random

from plumbline.llm.leakage import Passage, PassageIndex, bound, budget, contains, leaked_passages, leaks
from plumbline.llm.subtitles import folded_words, repaired, spoken

PASSAGE = "The rusty engine beside the vineyard was dropped by six sisters before sunrise, although Élska had guarded the noisy violin first."


def srt(lines, end="\n", stamp="00:00:{:02d},083 --> 00:00:{:02d},900"):
    return (end + end).join(f"{k}{end}{stamp.format(k, k)}{end}{line}" for k, line in enumerate(lines, 1)) + end


def test_speech_of_a_file():
    text = srt(["<i>THE RUSTY engine</i> beside", "Subtitles by Team Nobody", "[door creaks]", "MAREN: the vineyard\r\nwas dropped", "♪ slow waltz ♪"], "\r\n")
    assert folded_words(spoken(text)) == folded_words("the rusty engine beside the vineyard was dropped")
    assert folded_words("tlie engine, altliough tHe rnill") == folded_words("the engine although the mill")
    assert repaired("Güterschuppen".encode().decode("cp1252")) == "Güterschuppen" and repaired("touffés".encode().decode("cp437")) == "touffés" and repaired("año ¿qué?") == "año ¿qué?"


WORDS = "kotter garden window harvest violin between letters bridge morning winter anything summer".split()


def test_words_within_budget():
    assert budget(60) == 4 and budget(34) == 3 and budget(6) == 0 and bound(60) == 26 and all(bound(m) >= 1 for m in range(80))
    doc = ["before", *WORDS, "after"]
    assert contains(doc, WORDS, 12) and not contains(doc[2:], WORDS, 12)
    for changed, want in (
        (["ko**er", *WORDS[1:]], True), (["ko****", *WORDS[1:]], True), (["k*****", *WORDS[1:]], False), (["mottxr", *WORDS[1:]], False), (["koter", "gaarden", "wndow", "harvestt", *WORDS[4:]], True),
        (["koter", "gaarden", "wndow", "harvestt", "vioxin", *WORDS[5:]], False), (["kot", "ter", "gardenwindow", *WORDS[3:]], True), (["purple", *WORDS[1:]], False),
    ):
        assert contains(["before", *changed, "after"], WORDS, 12) is want, changed
    assert not contains(["before", *WORDS[:-1], "summertime"], WORDS, 12)
    short = "he is in on at by us to of or we go".split()
    assert contains(short, short, 12) and not contains(["hi", *short[1:]], short, 12)


def test_twelve_words_and_no_fewer(spark):
    words = PASSAGE.split()
    docs = [
        (1, srt([" ".join(words[:5]), "== synced by x ==", " ".join(words[5:14])])), (2, srt([" ".join(words[:11]), "Nothing else here."])), (3, srt(["Unrelated speech about a mill and a tailor and much else besides."])),
        (4, srt([" ".join(words[3:16]).upper().replace("E", "É")])), (5, srt([" ".join([*words[:8], "purple", *words[9:]])])), (6, None), (7, ""), (None, PASSAGE), (1, srt([PASSAGE])),
    ]
    items = [("i1", PASSAGE), ("i2", PASSAGE), ("i3", "too short"), ("i4", None), ("i5", ""), (None, PASSAGE)]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id string, passage string")
    want = {(k, n) for k in (1, 4) for n in ("i1", "i2")} | {(5, n) for n in ("i1", "i2") if len(words) - 9 >= 12}
    # also as one passage per index, and one per pass over the documents
    for block, part in ((400_000, 10_000), (60, 10_000), (60, 60)):
        got = [(r["doc_id"], r["item_id"]) for r in leaked_passages(d, i, block_letters=block, pass_letters=part).collect()]
        assert set(got) == want and len(got) == len(want)
    assert leaked_passages(d.limit(0), i).count() == 0 and leaked_passages(d, i.limit(0)).count() == 0


def damaged(rnd, part, edits):
    """The words of a leak with so many edits, each of any kind and in a word of its own, and
    with words split and joined."""
    out = list(part)
    long = [k for k, w in enumerate(out) if len(w) >= 4]
    for k in rnd.sample(long, min(edits, len(long))):
        w, at = out[k], rnd.randrange(len(out[k]))
        c = rnd.choice("abdeghklmnoprstuvwyz*")
        out[k] = rnd.choice((w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + c.replace("*", "a") + w[at:]))
    if rnd.random() < 0.5:
        k = rnd.randrange(len(out) - 1)
        out[k : k + 2] = [out[k] + out[k + 1]]
    if rnd.random() < 0.5:
        k = rnd.randrange(len(out))
        out[k : k + 1] = [x for x in (out[k][:2], out[k][2:]) if x]
    return out


def test_filter_loses_nothing():
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abdeghklmnoprstuvwyz") for _ in range(rnd.randint(2, 9))) for _ in range(80)]
    items = [(f"i{k}", [rnd.choice(vocabulary) for _ in range(40)]) for k in range(20)]
    texts, made = [], {}
    for k in range(400):
        w = [rnd.choice(vocabulary) for _ in range(60)]
        if k % 8:
            n, at, start, edits = rnd.choice((11, 12, 12, 12, 14)), rnd.randint(0, 50), rnd.randint(0, 20), k % 6
            w[at:at] = damaged(rnd, rnd.choice(items)[1][start : start + n], edits)
            made[k] = n, edits
        texts.append(w)
    index = PassageIndex.of([Passage(*x, 12) for x in items])
    want = {(k, i) for k, w in enumerate(texts) for i, p in items if contains(w, p, 12)}
    assert set(leaks(list(range(400)), texts, index, 12)) == want
    found = {k for k, _ in want}
    for edits in range(5):
        # every leak of twelve words within the budget is one by definition
        ours = [k for k, (n, e) in made.items() if n == 12 and e == edits]
        assert len(ours) > 10 and sum(k in found for k in ours) >= 0.9 * len(ours), edits
    assert sum(k in found for k, (n, _) in made.items() if n == 11) <= 5


def test_accents_lost_throughout(spark):
    passage = "Élska étudiait déjà près du château où la forêt était plus âgée que le père qui rêvait là-bas"
    lost = "".join("\ufffd" if ord(c) > 127 else c for c in passage)
    docs = spark.createDataFrame([(1, srt([lost])), (2, srt([passage]))], "doc_id long, text string")
    items = spark.createDataFrame([("i", passage)], "item_id string, passage string")
    assert sorted(r["doc_id"] for r in leaked_passages(docs, items).collect()) == [1, 2]
