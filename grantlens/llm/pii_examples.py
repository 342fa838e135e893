"""The labelled table of operator 13: lines of text with the personal data in them.

The lines are made from templates by a seeded rule, so the table is the same everywhere and can be made as long
as wanted.  A line is a list of pieces; a piece with a kind is personal data of that kind.  About half of the
lines hold none: dates, prices, versions, measures, keys, order numbers and references, which look alike.
"""

from __future__ import annotations

import random

_WORDS = ("the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were "
          "der die und das von mit den sich auf ist eine nicht le la les des un une est dans que pour el los las una con por para "
          "entre ciudad oficina informe casa tiempo reunion angebot vertrag woche bureau compte projet report meeting office team").split()
_NAMES = "anna ben carla david elena frank greta hugo ines jonas klara luis maria nils olga paul rosa sven tina victor".split()
_HOSTS = "mail post office example corp uni web home city lab net".split()
_ENDS = "com org net de fr es edu info co.uk".split()
_CUES = {
    "phone": ("call", "phone", "tel", "telephone", "mobile", "fax", "telefon", "tel.", "phone:", "call me at", "contact"),
    "email": ("mail", "email", "e-mail", "write to", "contact", "email:", "reach me at"),
    "ip": ("ip", "host", "server", "address", "from", "login from", "ip:"),
    "card": ("card", "visa", "card number", "karte", "tarjeta", "paid with", "card:"),
}


def luhn_digit(digits: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _digits(rng, n, first="123456789"):
    return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _phone(rng):
    a, b, c = _digits(rng, 3, "23456789"), _digits(rng, 3), _digits(rng, 4, "0123456789")
    return rng.choice([
        f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}",
        f"{a}.{b}.{c}", f"+{_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 7)}", f"00{_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 7)}",
        f"0{_digits(rng, 2)}/{_digits(rng, 7)}", f"0{_digits(rng, 1)} {' '.join(_digits(rng, 2) for _ in range(4))}"])


def _email(rng):
    user = rng.choice([rng.choice(_NAMES), f"{rng.choice(_NAMES)}.{rng.choice(_NAMES)}", f"{rng.choice(_NAMES)}{_digits(rng, 2)}"])
    host = f"{rng.choice(_HOSTS)}{rng.choice(['', '', _digits(rng, 1)])}"
    end = rng.choice(_ENDS)
    at = rng.choice(["@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] "])
    if at == "@" or rng.random() < 0.7:
        return f"{user}{at}{host}.{end}"
    return f"{user}{at}{host}[.]{end}" if "[" in at else f"{user}{at}{host}(dot){end}"


def _ip(rng):
    parts = [str(rng.randint(1, 255)) for _ in range(4)]
    return rng.choice([".", ".", "[.]", " . "]).join(parts)


def _card(rng):
    d = rng.choice("4523") + "".join(rng.choice("0123456789") for _ in range(14))
    d += luhn_digit(d)
    cut = [d[i:i + 4] for i in range(0, 16, 4)]
    return rng.choice([d, " ".join(cut), "-".join(cut), ".".join(cut), "/".join(cut), "  ".join(cut)])


def _other(rng):
    n = rng.randint
    return rng.choice([
        f"{n(1900, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", f"{n(1, 28):02d}.{n(1, 12):02d}.{n(1900, 2030)}", f"{n(1, 12)}/{n(1, 28)}/{n(1900, 2030)}",
        f"{n(0, 23):02d}:{n(0, 59):02d}", f"{n(0, 23):02d}:{n(0, 59):02d}:{n(0, 59):02d}", f"${n(1, 999)},{n(0, 999):03d}.{n(0, 99):02d}",
        f"{n(1, 99)}.{n(0, 99)} %", f"v{n(0, 9)}.{n(0, 20)}.{n(0, 20)}", f"{n(0, 9)}.{n(0, 20)}", f"({n(1900, 2030)})", f"{n(1, 9)} x {n(1, 9)} = {n(1, 81)}",
        f"order {_digits(rng, 8)}", f"no. {_digits(rng, 6)}", f"#{_digits(rng, 5)}", f"ISBN 978-{_digits(rng, 1)}-{_digits(rng, 4)}-{_digits(rng, 4)}-{_digits(rng, 1)}",
        f"token = \"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\"", f"password={''.join(rng.choice('0123456789abcdef') for _ in range(18))}",
        "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), f"{n(1, 999)} {n(100, 999)} {n(100, 999)}", f"{n(1, 500)} m",
        f"Copyright (c) {n(1990, 2026)}", f"section {n(1, 9)}.{n(1, 9)}.{n(1, 9)}", f"pp. {n(1, 99)}-{n(100, 300)}", f"[{n(1, 60)}]", f"{n(1, 20)}, {n(1, 20)}, {n(1, 20)}",
        f"@{rng.choice(_NAMES)}", f"{rng.choice(_WORDS)} (at) {rng.choice(_WORDS)}", f"f({rng.choice('xyz')}) = {n(1, 9)}", f"{_digits(rng, 16)}{rng.choice('abc')}",
        f"{n(1900, 2030)}-{n(1900, 2030)}", f"{rng.choice(_WORDS)}.{rng.choice(_WORDS)}", f"{_digits(rng, 4)} {_digits(rng, 4)}", f"+{n(1, 99)} %", f"{n(256, 999)}.{n(256, 999)}.{n(256, 999)}.{n(256, 999)}"])


_MAKE = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}


def _plain(rng, least, most):
    words = [rng.choice(_WORDS) for _ in range(rng.randint(least, most))]
    return " ".join(w.capitalize() if rng.random() < 0.15 else w for w in words) + rng.choice(["", "", ",", ".", "..."] if words else [""])


def labelled_lines(n: int, seed: int) -> list[list[tuple[str, str | None]]]:
    """``n`` lines, each a list of (piece, kind or None); the pieces joined are the line."""
    rng = random.Random(seed)
    lines = []
    for _ in range(n):
        line = [(_plain(rng, 0, 6) + " ", None)]
        for _ in range(rng.randint(0, 3)):
            if rng.random() < 0.5:
                kind = rng.choice(list(_MAKE))
                if rng.random() < 0.4:
                    line.append((rng.choice(_CUES[kind]) + " ", None))
                line.append((_MAKE[kind](rng), kind))
            else:
                if rng.random() < 0.2:
                    line.append((rng.choice(_CUES[rng.choice(list(_MAKE))]) + " ", None))
                line.append((_other(rng), None))
            line.append((rng.choice([" ", " ", ". ", ", ", " "]) + _plain(rng, 1, 5) + " " if rng.random() < 0.7 else
                         rng.choice([", ", " or ", " and ", " und ", " y ", "; ", " / "]), None))
        lines.append(line)
    return lines
