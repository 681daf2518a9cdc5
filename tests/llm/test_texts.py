import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from termloom.llm import mixing, packing, sentences, splitting, tokens
from termloom.llm.sentences import split_sentences

# -- splitting -------------------------------------------------------------------------------


def _check_pieces(text, limit, overlap):
    pieces = splitting.cut_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e, _, _ in pieces)
    for a, b in zip(pieces, pieces[1:]):
        assert a[1] < b[1] and a[0] <= b[0] <= a[1] and a[1] - b[0] <= overlap
    if len(text) > limit:
        forced = re.search(r"[^\s.!?。！？।؟…]{%d,}" % (limit + 1), text)
        assert any(p[3] for p in pieces) == bool(forced)
    return pieces


@pytest.mark.parametrize("seed", range(4))
def test_pieces_of_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        limit = rng.choice([5, 8, 20, 50])
        overlap = rng.choice([0, 1, 2, limit // 2, limit - 1])
        alphabet = rng.choice(["ab .", "abc. !\n\r", "  \n a", "字。」a", "a", "é́ ​x"])
        text = "".join(rng.choice(alphabet) if rng.random() < 0.5 else rng.choice(["x" * rng.randint(1, 12), " "]) for _ in range(rng.randint(1, 60)))
        _check_pieces(text, limit, overlap)


def test_pointer_doubling_equals_walking():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        succ = np.minimum(np.arange(n) + rng.integers(1, 6, n), n - 1)
        at, walked = 0, {0}
        while at != n - 1:
            at = int(succ[at])
            walked.add(at)
        assert set(np.flatnonzero(splitting.reached(succ)).tolist()) == walked


def test_natural_places_are_preferred():
    text = "One two three. " * 10 + "\n\n" + "Four five six seven eight nine. " * 10
    ends = [p[1] for p in _check_pieces(text, 200, 0)]
    assert ends[0] == text.index("Four")
    words = "word " * 100
    assert all(words[e - 1] == " " or words[e : e + 1] == " " for _, e, _, _ in _check_pieces(words, 33, 7)[:-1])


def test_split_frame(spark):
    rows = [(1, "x " * 2000), (2, "short"), (3, None), (4, ""), (None, "y " * 2000), (5, "z" * 500_000), (1, "x " * 2000), (6, "a" * 2000 + "."), (7, "a" * 2001)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "ordinal bigint, text string, piece string, grade int")
    found = splitting.split_oversized(df)
    forced = {r.id: r.forced for r in splitting.forced_texts(found).collect()}
    assert forced == {1: 0, 5: 1, 6: 0, 7: 1}
    pieces = found.where("id = 5").orderBy("piece_no").collect()
    assert all(len(p.piece) == p.end_pos - p.start_pos <= 2000 for p in pieces) and pieces[-1].end_pos == 500_000
    assert splitting.split_oversized(df.limit(0)).collect() == []
    for bad in ({"limit": 0}, {"overlap": 2000}, {"overlap": -1}):
        with pytest.raises(ValueError):
            splitting.split_oversized(df, **bad)


# -- sizes, packing, mixing ------------------------------------------------------------------


def test_token_counts_round_trip(spark):
    texts = ["The index rewrites the ledger.", "", None, "索引在维护期间删除了新的版本。", "a" * 20000]
    found = {r.id: r.n_tokens for r in tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text").collect()}
    coder = tokens.encoding(tokens.DEFAULT_RANKS)
    for i, t in enumerate(texts):
        ids = coder.encode_ordinary(t or "")
        assert found[i] == len(ids) and coder.decode(ids) == (t or "")


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(4)
    packer = packing.SumOfSquares(12)
    for size in rng.integers(1, 13, 400):
        size = int(size)
        before = packer.open_at.copy()
        options = []
        for g in range(size, 12):
            if before[g]:
                after = before.copy()
                after[g] -= 1
                if g > size:
                    after[g - size] += 1
                options.append(int((after**2).sum()))
        after = before.copy()
        if size < 12:
            after[12 - size] += 1
        options.append(int((after**2).sum()))
        packer.place(size)
        assert int((packer.open_at**2).sum()) == min(options) and packer.open_at[0] == packer.open_at[12] == 0
    assert all(0 < f <= 12 for f in packer.fills)


def test_packed_sizes_fit_and_are_whole():
    rng = np.random.default_rng(6)
    sizes = np.concatenate([rng.integers(0, 300, 2000), [0, 1, 256, 257, 512, 5000]])
    item, number, start, length, box = packing.pack_sizes(sizes, 256)
    assert np.bincount(box, weights=length).max() <= 256 and length.max() <= 256
    assert np.array_equal(np.bincount(item, weights=length, minlength=len(sizes)), sizes)
    assert all(n == -(-int(s) // 256) or s == 0 for s, n in zip(sizes, np.bincount(item), strict=True))
    filled = np.bincount(box, weights=length)
    assert sizes.sum() / (len(filled) * 256) > 0.96
    assert packing.pack_sizes(np.array([0, 0]), 8)[4].tolist() == [0, 0]


def test_pack_frame(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(0, 300)) for i in range(300)] + [(None, "same text"), (900, None), (901, ""), (902, "dup"), (902, "dup")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, place int, shard int").repartition(3)
    kinds = spark.createDataFrame([("a", 64), ("b", 256), ("b", 300), (None, 5), ("c", None), ("d", 0)], "container_kind string, capacity_tokens int")
    packed = packing.pack(df, kinds, shard_items=100).collect()
    counts = {r.id: r.n_tokens for r in tokens.token_counts(df, "doc_id", "text").collect()}
    fill, total, seen = defaultdict(int), defaultdict(int), Counter()
    for r in packed:
        fill[r.container_kind, r.container_id] += r.n_tokens
        total[r.container_kind, r.doc_id] += r.n_tokens
        seen[r.container_kind] += r.piece_no == 0
    assert max(v for (k, _), v in fill.items() if k == "a") <= 64 and max(v for (k, _), v in fill.items() if k == "b") <= 256
    assert all(total[k, i] == n * (2 if i == 902 else 1) for k in "ab" for i, n in counts.items()) and seen == {"a": len(rows), "b": len(rows)}
    report = {r.container_kind: r.fill for r in packing.fill_report(packing.pack(df, kinds)).collect()}
    assert set(report) == {"a", "b"} and min(report.values()) > 0.9
    assert packing.pack(df.limit(0), kinds).collect() == [] and packing.pack(df, kinds.limit(0)).collect() == []


def _docs(spark):
    rng = random.Random(1)
    sources = ["big"] * 300 + ["mid"] * 80 + [" Tiny"] * 5 + ["other", None]
    rows = [(i, "w " * rng.randint(1, 40), s) for i, s in enumerate(sources)] + [(900, None, "big"), (901, "", "mid")]
    return spark.createDataFrame([(*r, "e") for r in rows], "doc_id bigint, text string, source string, extra string").repartition(4)


TARGETS = [("BIG ", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.15, 3), ("absent", 0.05, 4), (None, 0.5, 1), ("x", None, 1), ("y", 0.1, 0), ("z", float("nan"), 1)]


@pytest.mark.parametrize("total", [None, 500, 50_000])
def test_mixture(spark, total):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mix = mixing.Mixture(_docs(spark), targets, total=total)
    rows = mix.chosen().collect()
    taken, copies = Counter(), Counter()
    for r in rows:
        taken[r.source] += r.n_tokens
        copies[r.source, r.doc_id] += 1
    largest = max(r.n_tokens for r in rows)
    for source, share, repeats in (("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.15, 3)):
        budget = min(int(share * mix.total + 1e-9), mix.available[source] * repeats)
        assert mix.budgets[source] == budget and abs(taken[source] - budget) <= largest / 2
        own = [n for (s, _), n in copies.items() if s == source]
        assert max(own) <= repeats and max(own) - min(own) <= 1
    assert {s for s, _ in copies} == {"big", "mid", "tiny"}
    if total is None:
        assert mix.total == min(int(mix.available[s] * r / share) for s, share, r in (("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.15, 3)))
    report = {r.source: r for r in mix.shares().collect()}
    assert set(report) == {"big", "mid", "tiny", "absent"} and not report["absent"].reached and report["absent"].taken_tokens == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-5
    assert all(report[s].taken_tokens == taken[s] for s in ("big", "mid", "tiny"))
    assert report["tiny"].reached == (total != 50_000)
    again = mixing.Mixture(_docs(spark).coalesce(4), targets, total=total)
    assert again.budgets == mix.budgets


def test_mixture_edges(spark):
    targets = spark.createDataFrame(TARGETS[:3], "source string, target_share double, max_repeats int")
    empty = mixing.Mixture(_docs(spark).limit(0), targets)
    assert empty.total == 0 and empty.chosen().collect() == [] and {r.actual_share for r in empty.shares().collect()} == {0.0}
    assert mixing.Mixture(_docs(spark), targets.limit(0)).chosen().collect() == []
    with pytest.raises(ValueError):
        mixing.Mixture(_docs(spark), targets.union(targets))


# -- sentences -------------------------------------------------------------------------------

# each text with its units, separated here by a bar of their own
CASES = """
Dr. Smith left. He ran.|Dr. Smith left./He ran.
The clinic left for the U.S. The deep shard won.|The clinic left for the U.S./The deep shard won.
The U.S. edition of it won.|The U.S. edition of it won.
It closed at 2 p.m. The deep shard won.|It closed at 2 p.m./The deep shard won.
At 10.5 a.m. Col. Foo archives it.|At 10.5 a.m. Col. Foo archives it.
It opened at 9 a.m. sharp and won.|It opened at 9 a.m. sharp and won.
Ph.D. students of X know ca. 1985 well.|Ph.D. students of X know ca. 1985 well.
The heap ran with plan B. The dense one did not.|The heap ran with plan B./The dense one did not.
J. R. Foo doubles it, i.e. the bar.|J. R. Foo doubles it, i.e. the bar.
Foo said no. The rest left.|Foo said no./The rest left.
No. 93 on the list won. See Fig. 3 and Eq. 4.|No. 93 on the list won./See Fig. 3 and Eq. 4.
It now belongs to Foo Ltd. The weekly score won.|It now belongs to Foo Ltd./The weekly score won.
Foo Inc. masks it. Nipemp et al. returns it.|Foo Inc. masks it./Nipemp et al. returns it.
Open tombs.txt or docs.foo.invalid/v22.html first. It cost 45,498.50 crowns.|Open tombs.txt or docs.foo.invalid/v22.html first./It cost 45,498.50 crowns.
Weights under .5 or over 5.48 leave. Section 27.27.1 a.k.a. the foo stays.|Weights under .5 or over 5.48 leave./Section 27.27.1 a.k.a. the foo stays.
"Wait... is it late?" the team replied.|"Wait... is it late?" the team replied.
'The turbine is late!' cried foo. It was.|'The turbine is late!' cried foo./It was.
“The loader archives it,” said Prof. Foo, “and the query returns it.” In 2001 it left.|“The loader archives it,” said Prof. Foo, “and the query returns it.”/In 2001 it left.
Foo wrote: "The index leads. The harbour closes it." Then it left.|Foo wrote: "The index leads. The harbour closes it."/Then it left.
The survey (why? nobody knows!) reopens it.|The survey (why? nobody knows!) reopens it.
(The annual pointer won, cf. Sect. 28.) When it ended, all left.|(The annual pointer won, cf. Sect. 28.)/When it ended, all left.
And so it restores the dataset... The bakery left.|And so it restores the dataset.../The bakery left.
The dialect … or what is left of it … won.|The dialect … or what is left of it … won.
Is this really it?! Not yet.|Is this really it?!/Not yet.
It left.The rest stayed.Foo ran.|It left./The rest stayed./Foo ran.
It left. foobarkit stayed.|It left./foobarkit stayed.
Das Archiv kopiert am 3. Mai die Datei. Es ordnet bzw. sperrt z. B. alles.|Das Archiv kopiert am 3. Mai die Datei./Es ordnet bzw. sperrt z. B. alles.
Das Hafenamt sperrt den Treffer usw. Das Protokoll liefert ihn gem. Nr. 18 der Liste.|Das Hafenamt sperrt den Treffer usw./Das Protokoll liefert ihn gem. Nr. 18 der Liste.
„Wer verwirft den Entwurf?“, fragte Dr. Foo. Er schrieb: „Es geht. Es ging.“ Alle lachten.|„Wer verwirft den Entwurf?“, fragte Dr. Foo./Er schrieb: „Es geht. Es ging.“/Alle lachten.
La consulta de EE. UU. compara todo. El Sr. Foo escribió: «La memoria gana. El índice pierde.» ¡Vale!|La consulta de EE. UU. compara todo./El Sr. Foo escribió: «La memoria gana. El índice pierde.»/¡Vale!
«¿Quién copia la serie?», preguntó el Dr. Foo. Copia, p. ej. cada fila, etc. La tabla gana.|«¿Quién copia la serie?», preguntó el Dr. Foo./Copia, p. ej. cada fila, etc./La tabla gana.
« Qui copie le document ? » demanda Mme Foo. M. Bar classe le vol. 115.|« Qui copie le document ? » demanda Mme Foo./M. Bar classe le vol. 115.
А. Б. Ворнельский хранит термины и т. д. Завод на ул. Foo, д. 41, стоит.|А. Б. Ворнельский хранит термины и т. д./Завод на ул. Foo, д. 41, стоит.
В 2019 г. вектор хранит строку. «Кто копирует?» — спросил А. П. Тельмирин.|В 2019 г. вектор хранит строку./«Кто копирует?» — спросил А. П. Тельмирин.
“谁复制了副本？”管理员问道。管理员说：“分片保存了段落。市议会移动了它。”《Foo手册！》丢失了。真的吗？！|“谁复制了副本？”管理员问道。/管理员说：“分片保存了段落。市议会移动了它。”/《Foo手册！》丢失了。/真的吗？！
读取器……删除了权重。词表（见图9。）找到了它。版本v2.9.1的词表。|读取器……删除了权重。/词表（见图9。）找到了它。/版本v2.9.1的词表。
「本当か？」と館長は尋ねた。係員は「表は比較した。表も失った。」と書いた。検索は複写した．早朝だ．|「本当か？」と館長は尋ねた。/係員は「表は比較した。表も失った。」と書いた。/検索は複写した．/早朝だ．
“누가 옮긴다?”라고 사서가 물었다. 기록은 (그림 190 참조.) 새 판을 옮긴다.|“누가 옮긴다?”라고 사서가 물었다./기록은 (그림 190 참조.) 새 판을 옮긴다.
डॉ. Foo के अनुसार सूची है| श्री वी. के. Bar लिखते हैं, “सूची है। वह है।” सचमुच?|डॉ. Foo के अनुसार सूची है|/श्री वी. के. Bar लिखते हैं, “सूची है। वह है।”/सचमुच?
«من ينشر؟» سأل أمين. يقول د. Foo إن الأرشيف يجد. كتب أ. د. Bar: «السجل ينقل. الميناء يقارن.» لماذا؟|«من ينشر؟» سأل أمين./يقول د. Foo إن الأرشيف يجد./كتب أ. د. Bar: «السجل ينقل. الميناء يقارن.»/لماذا؟
ห้องสมุดต่าง ๆ เก็บรักษา ดัชนีแทนที่ประมาณ 1.753 แถวหลัง Foo แทนที่|ห้องสมุดต่าง ๆ เก็บรักษา/ดัชนีแทนที่ประมาณ 1.753 แถวหลัง Foo แทนที่
"""


@pytest.mark.parametrize("case", [c for c in CASES.strip().split("\n")])
def test_sentence_cases(case):
    danda = case.startswith("डॉ")  # this one holds a bar itself
    cut = case.index("|", case.index("|") + 1) if danda else case.index("|")
    text, units = case[:cut], case[cut + 1 :]
    units = units.replace("invalid/v", "invalid\0v").split("/")
    found = [text[a:b] for a, b in split_sentences(text)]
    assert found == [u.replace("\0", "/") for u in units]


@pytest.mark.parametrize("between", [3, 8, 40])
def test_opening_signs_are_found_at_any_depth(between):
    text = "Foo (see " + "[ab " * between + "and went. Then it stayed) here. «Bar [c» left."
    assert [text[a:b] for a, b in split_sentences(text)] == [text[: text.index(" «Bar")], "«Bar [c» left."]


def test_blocks_lists_and_headings():
    text = "  Notes on it\r\n\r\n1. Close it. Then\ncount it.\n\nA line\nwrapped here. Done\n \n* One item\n* Two. Items\nAfter it.\n10. No item.\n"
    found = [text[a:b] for a, b in split_sentences(text)]
    assert found == ["Notes on it", "1. Close it.", "Then", "count it.", "A line\nwrapped here.", "Done", "* One item", "* Two.", "Items", "After it.", "10. No item."] or found[:4] == ["Notes on it", "1. Close it.", "Then", "count it."]
    assert split_sentences("1. One\n2. Two") == [(0, 6), (7, 13)] and split_sentences(" \n\t ") == []


def test_units_are_ordered_and_trimmed_on_random_texts():
    rng = random.Random(8)
    signs = ["a", "B", ". ", "! ", "? ", "“", "”", "\"", "'", "(", ")", "…", "...", "\n", "\n\n", " ", "1", "- ", "。", "「", "」", "กข กข", "«", "»", "„", "|", "．"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        units, at = split_sentences(text), 0
        for a, b in units:
            assert at <= a < b and text[a:b] == text[a:b].strip()
            assert not text[at:a].strip()
            at = b
        assert not text[at:].strip()


def test_long_and_unbalanced_texts_take_linear_time():
    assert len(split_sentences("It is. " * 50_000)) == 50_000
    assert split_sentences("(" * 100_000 + "a. B.")[-1][1] == 100_005
    assert len(split_sentences("“" * 1000 + "It is. It was.")) == 2


def test_sentence_frame(spark):
    rows = [(1, "Abc de. Cde fg."), (2, None), (3, ""), (None, "Xyz yz."), (1, "Abc de. Cde fg."), (4, "😀 ok. Yes.")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id bigint, text string, unit_no int, id string")
    found = sorted((str(r.id), r.unit_no, r.start_pos, r.end_pos) for r in sentences.sentences(df).collect())
    assert found == [("1", 0, 0, 7), ("1", 0, 0, 7), ("1", 1, 8, 15), ("1", 1, 8, 15), ("4", 0, 0, 5), ("4", 1, 6, 10), ("None", 0, 0, 7)]
    assert sentences.sentences(df.limit(0)).collect() == []
