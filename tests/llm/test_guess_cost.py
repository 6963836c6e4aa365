"""The guess-cost programme against all segmentations, planted secrets and placeholders, and long values."""

import itertools
import math
import random
import time

import pytest
from geobucket.llm import guess_cost as G

PLACEHOLDERS = ["getPassword()", "process.env.TOKEN", "your-api-key-here", "config.token.value", "get_token()", "<your-password>", "${DB_PASSWORD}", "self.session.token", "new_password_here", "xxxxxxxxxxxx", "ab" * 200, "a" * 500, "0123456789", "qwertyuiop", "2024-01-31"]


def span_cost(value: str, i: int, j: int) -> float:
    """The cheapest way to guess value[i:j] as one span, by the definitions."""
    own, low, found = value[i:j], value[i:j].lower(), [math.inf]
    if all(c in "0123456789abcdef" for c in value):
        size = 16
    else:
        size = sum(n for n, is_in in ((10, str.isdigit), (26, str.isupper), (26, str.islower), (33, lambda c: not c.isalnum())) if any(map(is_in, value)))
    each = math.log10(size)
    if len(own) == 1:
        found.append(each)
    if low in G.SEPARATORS:
        found.append(math.log10(G.SEPARATORS.index(low) + 2))
    if 3 <= len(own) <= 64:
        rank, extra = G.WORD_RANK.get(low), 0.0
        if rank is None:
            rank, extra = G.WORD_RANK.get(low.translate(G.STANDS_FOR)), math.log10(4)
        if rank:
            upper = [c.isupper() for c in own]
            letters = [c.isupper() for c in own if c.isalpha()]
            extra += 0 if not any(upper) else math.log10(2) if all(letters) or upper[0] and not any(upper[1:]) else math.log10(8)
            found.append(math.log10(rank + 1) + extra)
    if (m := G._DATE.match(value, i, min(len(value), i + 10))) and m.end() == j:
        found.append(math.log10(150) if j - i == 4 else math.log10(365 * 150))
    for pattern, days in ((G._TIME, 1), (G._STAMP, 365 * 150)):
        if (m := pattern.match(value, i)) and m.end() == j:
            found.append(math.log10(days * 24 * 60 * (60 if own.count(":") - ("+" in own) > 1 else 1)))
    for unit in range(1, len(own) // 2 + 1):
        copies = len(own) // unit
        again = value.lower().startswith(low[:unit], j)
        if low == low[:unit] * copies and not again and copies > (2 if unit == 1 else 1):
            found.append(unit * each + math.log10(copies))
    steps = [G.NEXT.get(a, {}).get(b) for a, b in zip(low, low[1:])]
    if len(own) >= 3 and None not in steps:
        turns = 1 + sum(a != b for a, b in zip(steps, steps[1:]))
        found.append(math.log10(47 * len(own)) + turns * math.log10(4))
    return min(found)


def all_segmentations(value: str) -> float:
    n = len(value)
    return min(sum(itertools.starmap(lambda i, j: span_cost(value, i, j), itertools.pairwise([0, *cuts, n]))) for k in range(n) for cuts in itertools.combinations(range(1, n), k))


def test_cost_is_the_least_of_all_segmentations():
    r = random.Random(7)
    made = ["".join(r.choice("abAB12_.") for _ in range(r.randint(1, 9))) for _ in range(60)]
    made += ["".join(r.choice("qwertas12") for _ in range(9)) for _ in range(40)]
    made += ["".join(r.choice("0123:5a") for _ in range(8)) for _ in range(60)] + ["1999-12-31 23:59", "12:30-13:45", "9:05:00x"]
    made += ["P4ssw0rd1", "get_token", "test1999x", "1999-12-31", "abababab", "aaaaaaab", "asdfTest", "deadbeef1", "1q2w3e4r", "roottoor"]
    for value in made:
        assert G.guess_cost(value) == pytest.approx(all_segmentations(value), abs=1e-9), value


def test_limit_changes_no_verdict():
    r = random.Random(3)
    for _ in range(400):
        value = "".join(r.choice(["a", "ab", "test", "_", "9", "Q", "1999"]) for _ in range(r.randint(1, 8)))
        assert G.guess_cost(value, limit=10.0) == min(10.0, G.guess_cost(value))


def test_planted_secrets_and_placeholders():
    r = random.Random(1)
    letters, mixed = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#!%"
    planted = ["".join(r.choice(letters) for _ in range(12)) for _ in range(300)] + ["".join(r.choice(mixed) for _ in range(10)) for _ in range(300)]
    caught = sum(any(k == 3 for _, k, _, _ in G.secret_spans(f'x password = "{v}" y')) for v in planted)
    assert caught >= 0.99 * len(planted)
    for v in PLACEHOLDERS:
        assert not any(k == 3 for _, k, _, _ in G.secret_spans(f"x secret: {v} y")), v


def test_times_and_places():
    """A place is as hard as its hardest part."""
    plain = ["12:30-13:45", "2024-01-31T12:30:59Z", "2024-01-31T12:30:59.123+01:00", "https://example.com/login", "https://api.example.com/user/data/test?name=value", "/home/user/config/settings/data.file", "../config/auth/session.data", "C:\\data\\config\\settings", "admin@example.com", "größe.änder@example.com"]
    hard = ["https://user:kTqWzXvBnRfJ@example.com/", "https://example.com/hook/B7kQz9XwLm2", "/kTqWzXvBnRfJ/data", "https://example.com/?key=q8ZrTx0LwVb", "q8#Zr!x0Lw@x", "12:30kTqWzXvB"]
    assert [G.is_secret(v) for v in plain + hard] == [False] * len(plain) + [True] * len(hard)


def test_spans_of_the_method_lie_beside_base_spans():
    text = "token=kTqWzXvBnRfJ pwd: kTqWzXvB password: hunter2hunter2"
    assert G._said(G.secret_spans(text)) == "assign:0:18,guess:6:18,guess:24:32,assign:33:57"


def test_time_follows_the_length():
    """10 MB in one value, one repetition, one walk; and the work for twice as many assignments is no more than three times as much."""
    r = random.Random(1)
    for value in ("".join(r.choices("abcdefghijklmnop0123", k=10**7)), "ab1" * 3_300_000, "a" * 10**7, "asas" * 2_500_000):
        began = time.perf_counter()
        G.secret_spans(f"secret={value}")
        assert time.perf_counter() - began < 30
    took = []
    for n in (20_000, 40_000):
        began = time.perf_counter()
        assert sum(k == 0 for _, k, _, _ in G.secret_spans("token: abcdefgh1x9z " * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 3 * took[0] + 0.5
