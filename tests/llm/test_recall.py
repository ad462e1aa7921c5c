"""Personal data planted in every kind and form: recall and precision by kind."""

import random
import re
from collections import Counter

from trialgrid.llm import pii

WORDS = "we met at noon and walked down to the harbour where boats come in on most days of the year with fish and mail for the town".split()


def luhn_card(rng):
    digits = [rng.randint(1, 9) for _ in range(15)]
    for last in range(10):
        number = "".join(map(str, [*digits, last]))
        if pii.luhn(number):
            return number


def planted(seed=1, texts=240):
    """(texts, planted (text number, kind, start, end, form)); numbers that are no personal data stand between them."""
    rng = random.Random(seed)
    out, marks = [], []
    for i in range(texts):
        country, number = rng.choice(["49-30", "1-555", "33-1"]), f"{rng.randint(1000000, 9999999)}"
        card, who = luhn_card(rng), f"{rng.choice(WORDS)}.{rng.choice(WORDS)}{rng.randint(1, 99)}"
        ip = ".".join(str(rng.randint(1, 254)) for _ in range(4))
        forms = {
            "phone": [("rule", f"+{country}-{number}"), ("bare", number), ("dots", f"{country.replace('-', '.')}.{number[:3]}.{number[3:]}"), ("again", number)],
            "card": [("rule", " ".join(card[k : k + 4] for k in range(0, 16, 4))), ("rule", card), ("dots", ".".join(card[k : k + 4] for k in range(0, 16, 4)))],
            "email": [("rule", f"{who}@example.org"), ("rule", f"{who.upper()}@EXAMPLE.org")],
            "ip": [("rule", ip), ("rule", ip)],
        }
        kind = list(forms)[i % 4]
        parts = []
        for form, value in forms[kind]:
            parts += [(None, None, " ".join(rng.choices(WORDS, k=rng.randint(3, 12)))), (kind, form, value)]
        parts.append((None, None, rng.choice(WORDS)))
        others = [f"room {rng.randint(1, 400)}", f"in {rng.randint(1900, 2030)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", f"{rng.randint(1, 99)}%", f"order {rng.randint(1000000, 9999999)}", f"{rng.randint(1, 12)}:{rng.randint(10, 59)}"]
        for other in rng.sample(others, 4):
            parts.insert(2 * rng.randint(0, len(parts) // 2), (None, None, f"{rng.choice(WORDS)} {other} {rng.choice(WORDS)}"))  # digits side by side are one run to the rules
        text = ""
        for own, form, value in parts:
            text += " " if text else ""
            if own:
                marks.append((i, own, len(text), len(text) + len(value), form))
            text += value
        out.append(text)
    return out, marks


def test_recall_and_precision_by_kind(spark, capsys):
    texts, marks = planted()
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    meets = lambda a, b: a[0] == b[0] and a[1] < b[2] and a[2] > b[1]
    caught, all_, right, given = Counter(), Counter(), Counter(), Counter()
    for i, kind, start, end, form in marks:
        for key in (kind, (kind, form)):
            all_[key] += 1
            caught[key] += any(meets((kind, start, end), s) for s in found[i])
    own = {}
    for i, kind, start, end, _ in marks:
        own.setdefault(i, []).append((kind, start, end))
    for i, spans in found.items():
        for s in spans:
            given[s[0]] += 1
            right[s[0]] += any(meets(s, m) for m in own[i])
    with capsys.disabled():
        print({str(k): f"{caught[k]}/{all_[k]}" for k in all_}, {k: f"{right[k]}/{given[k]}" for k in given})
    for kind in pii.KINDS:
        assert caught[kind] >= 0.9 * all_[kind], kind
        assert right[kind] >= 0.9 * given[kind], kind
    for key, n in all_.items():
        assert caught[key] >= 0.9 * n, key


def test_texts_hold_the_forms():
    texts, marks = planted()
    assert all(re.search(r"\d", texts[i][s:e]) for i, _, s, e, _ in marks)
