"""Pages without marks, with marks that hold little, and in languages without a stop word list; labels by a version of their own."""

import random
import re

import pytest

from pagewright.llm import html_extract

#: A paragraph or two of each language, written for these tests.
PROSE = {
    "en": ["The river is low in the summer and the boats of the village lie on the sand until it rains again in the hills.", "It was the oldest of the mills that had been built on the bank, and nobody in the town knew who owned it."],
    "ru": ["Река летом мелеет, и лодки деревни лежат на песке, пока в горах не пойдёт дождь, а потом и на берегу и в саду снова шумно.", "На берегу стояла мельница, и никто в городе не знал, кому она принадлежит, но на ней и в будни и в праздники горел свет."],
    "pl": ["Latem rzeka jest niska i łodzie leżą na piasku, a w górach nie pada, i na brzegu jest cicho, a w polu i w lesie też.", "Na brzegu stał młyn i nikt w mieście nie wiedział, do kogo on należy, a i tak w nim co noc na górze paliło się światło."],
    "el": ["Το καλοκαίρι το ποτάμι έχει λίγο νερό και οι βάρκες μένουν στην άμμο και στο χωριό και το βράδυ ο κόσμος βγαίνει στην όχθη.", "Στην όχθη ήταν ο μύλος και κανείς στο χωριό δεν ήξερε ποιος τον έχει, και το φως του το βράδυ το έβλεπαν και από το βουνό."],
    "fi": ["Kesällä joki on matala ja veneet ovat hiekalla, ja kun on sade vuorilla, ne ovat taas vedessä ja lapset ovat rannalla.", "Rannalla oli mylly ja kukaan ei tiennyt kenen se oli, ja yöllä oli aina valo ylhäällä ja se oli kaunis ja se oli outo."],
    "tr": ["Yazın nehir çok az akar ve köyün tekneleri kumda kalır, ve dağda yağmur yağınca su gelir ve o gün çok ses olur ve çok insan gelir.", "Kıyıda bir su değirmeni vardı ve kimse onun kimin olduğunu bilmezdi, ve gece bir ışık hep orada yanardı ve bir de ses vardı."],
    "he": ["בקיץ הנהר נמוך וכל הסירות של הכפר על החול, עד שיש גשם על ההר, ואז יש מים וגם יש רעש של ילדים על הגדה וגם יש שיר.", "על הגדה עמדה טחנה ואף אחד לא ידע של מי היא, וגם אם לא היה שם איש, היה שם אור על הגג, וגם היה שם קול של שיר."],
    "vi": ["Mùa hè sông rất cạn và các con đò nằm trên cát, khi có mưa ở trên núi thì nước về và các con đò lại đi trên sông.", "Ở trên bờ có cối xay và không ai ở trong làng biết nó là của ai, mà đêm nào cũng có đèn ở trên mái và có tiếng ở trong."],
    "ja": ["夏になると川の水は少なくなり、村の舟は砂の上に置かれたままになる。山に雨が降ると水が戻り、子どもたちはまた岸辺に集まってくる。そして夜になると、明かりが水面に映り、遠くの家からも歌声が聞こえてくる。", "岸辺には古い水車小屋があり、誰のものか町の人は誰も知らなかった。夜になると窓に明かりがともり、遠い山からも見えたという。その音は川の流れとともに、昔から変わらず村じゅうに静かに響いていたそうだ。"],
    "zh": ["夏天河水很浅，村里的船都停在沙滩上。等到山里下了雨，水又涨起来，孩子们便回到岸边玩耍。晚上灯光映在水面上，远处的人家也能听见歌声，老人们坐在门前，说起从前发大水的那一年，船一直划到了祠堂的台阶下。", "岸边有一座老磨坊，镇上没有人知道它是谁的。每天夜里窗口都亮着灯，从很远的山上也能看见。那声音随着河水流淌，多少年来一直没有改变，人们早已习惯，若是有一晚听不到，反倒会觉得心里空落落的。"],
}
NAV = "<div><ul><li><a href='/'>Home and all of the news of the day</a></li><li><a href='/a'>More of the same for you and for all who want to read it</a></li></ul></div>"
FOOT = "<div><a href='/terms'>Terms of use and what they are for in all of the countries</a> | <a href='/contact'>Contact</a></div><footer>All rights of this site are with the owner of the site and not with you.</footer>"


def page(body):
    return f"<html><head><title>t</title></head><body>{NAV}{body}{FOOT}</body></html>"


@pytest.mark.parametrize("lang", sorted(PROSE))
@pytest.mark.parametrize("tag", ["div", "article", "main", "section"])
def test_whole_articles_of_many_languages(lang, tag):
    one, other = PROSE[lang]
    title = one.split()[0][:9]
    for paragraphs in ([one, other], [one, other, one], [other]):
        got = html_extract.main_text(page(f"<{tag}><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</{tag}>"))
        # a heading that stands alone before the first paragraph is as near to the menu as to the text
        assert got in (" ".join([title, *paragraphs]), " ".join(paragraphs)) and (tag not in ("article", "main") or got.startswith(title))


def test_a_teaser_in_a_mark_does_not_hide_the_article():
    one, other = PROSE["en"]
    # the teaser itself is as near to the links as to the text
    assert html_extract.main_text(page(f"<div><p>{one}</p><p>{other}</p></div><article><h3>short one</h3></article>")) == f"{one} {other}"
    assert html_extract.main_text(page(f"<article><p>{one}</p></article><div><p>{one}</p><p>{other}</p></div>")) == f"{one} {one} {other}"
    # where the mark holds most of it, what is outside goes
    assert html_extract.main_text(page(f"<article><p>{one}</p><p>{other}</p></article><div><p>{one[:80]}</p></div>")) == f"{one} {other}"


def test_tables_and_code_between_paragraphs_stay():
    one, other = PROSE["en"]
    cells = "".join(f"<td>Mill {k} Kestrel Harrow Quarry Linden Barrow Hollis Marten Rowan Sedge Thistle Yarrow</td>" for k in range(3))
    code = "x = compute(alpha, beta, gamma); print(x); store[x] = delta * epsilon - zeta / eta + theta"
    got = html_extract.main_text(page(f"<p>{one}</p><table><tr>{cells}</tr></table><p>{other}</p><pre>{code}</pre><p>{one}</p>"))
    assert got.count("Kestrel") == 3 and code in got and got.startswith(one) and got.endswith(one)
    # long lists of links next to the menu still go
    assert "rights" not in got and "Home" not in got and "Terms" not in got


def plain_labels(found):
    """Both passes, written anew: letters by str.isalpha, neighbours by looking outwards."""
    words = lambda text: "".join(c if c.isalpha() else " " for c in text.lower()).split()
    long = [not aside and not head and linked <= 0.5 and len(text) >= 70 for text, linked, aside, _, head in found]
    every = [w for (text, *_), x in zip(found, long, strict=True) if x for w in words(text)]
    listed = [w for w in every if w in html_extract.STOP_WORDS]
    stops = html_extract.STOP_WORDS if 10 * len(listed) >= len(every) else {w for w in every if len(w) <= 4 and every.count(w) > 1}
    labels = []
    for (text, linked, aside, _, _), x in zip(found, long, strict=True):
        own = words(text)
        if aside or linked > 0.5:
            labels.append("bad")
        elif not x:
            labels.append("short")
        elif own and 5 * sum(w in stops for w in own) >= len(own) or own and sum(map(len, own)) > 12 * len(own) and sum(c in "。、！？，；：．।။។" for c in text) > 1:
            labels.append("good")
        else:
            labels.append("near")
    return labels if "good" in labels else ["good" if x == "near" else x for x in labels]


def plain_kept(found, labels, marked):
    out = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            out.append(label == "good")
            continue
        reach = {}
        for j, other in enumerate(labels):
            if other in ("good", "bad") and not found[j][2]:
                side = j > i
                if side not in reach or abs(j - i) < reach[side][0]:
                    reach[side] = (abs(j - i), other)
        if not reach:
            out.append(True)
            continue
        least = min(d for d, _ in reach.values())
        near = {x for d, x in reach.values() if d == least}
        out.append(near == {"good"} or len(near) == 2 and (marked or label == "near"))
    return out


def test_both_passes_against_their_own_version():
    r = random.Random(2)
    names = {html_extract.BAD: "bad", html_extract.SHORT: "short", html_extract.NEAR: "near", html_extract.GOOD: "good"}
    prose = [p for x in PROSE.values() for p in x]
    seen = set()
    for _ in range(1500):
        few = r.sample(prose, 3)
        found = []
        for _ in range(r.randint(0, 12)):
            text = r.choice([r.choice(few), "Short.", "Kestrel Harrow Quarry Linden Barrow Hollis Marten Rowan Sedge Thistle Yarrow Fennel Sorrel", "12 34 " * 20])
            found.append((" ".join(re.sub(r"\s+", " ", text).split()), r.choice([0.0, 0.0, 0.2, 0.9]), r.random() < 0.15, r.random() < 0.5, r.random() < 0.1))
        labels = html_extract.decided(found)
        want = plain_labels(found)
        assert [names[x] for x in labels] == want
        for marked in (False, True):
            assert html_extract.second_pass(labels, [b[2] for b in found], marked) == plain_kept(found, want, marked)
        seen |= set(want)
    assert seen == {"bad", "short", "near", "good"}
