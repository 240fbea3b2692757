"""Texts with planted identifiers: seeds in fixed formats, ones that no format knows, and numbers in other contexts."""


def planted(rng, count=60):
    """(id, text) rows; (id, kind, start, end) of identifiers in unseen formats; (id, start, end) of decoys."""
    fill = ["thon", "er", "la", "und", "the", "oring", "que", "ment", "die", "schaft"]
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    contexts = {"phone": ["call my mobile", "ring her desk", "tel="], "email": ["please write to", "mail:"], "ip": ["logged in from host", "addr="]}
    seeds = {
        "phone": lambda: f"+{rng.randint(1, 9)} {digits(3)} {digits(3)} {digits(4)}", "email": lambda: f"{rng.choice(fill)}{digits(3)}@{rng.choice(fill)}{digits(2)}.org",
        "ip": lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)),
    }
    unseen = {"phone": [lambda: f"0{digits(3)}-{digits(5)}", lambda: f"({digits(3)}) {digits(3)} {digits(4)}"], "email": [lambda: f"{rng.choice(fill)}{digits(3)}@localhost"], "ip": []}
    beside = ["order number", "he paid", "in section", "total="]
    docs, hidden, decoys = [], set(), set()

    def add(lead, said):
        head = " ".join(rng.choices(fill, k=rng.randint(2, 6))) + " " + lead + ("" if lead[-1] in "=:" else " ")
        docs.append((len(docs), head + said + rng.choice([" ", ", ", ". "]) + " ".join(rng.choices(fill, k=3))))
        return len(docs) - 1, len(head), len(head) + len(said)

    for kind, leads in contexts.items():
        for lead in leads:
            for _ in range(count):
                add(lead, seeds[kind]())
            for make in unseen[kind]:
                for _ in range(count // 20):
                    doc, s, e = add(lead, make())
                    hidden.add((doc, kind, s + docs[-1][1][s:e].find(docs[-1][1][s:e].strip("()")), e))
    for lead in beside:
        for _ in range(count // 2):
            doc, s, e = add(lead, digits(rng.randint(5, 8)))
            decoys.add((doc, s, e))
    for _ in range(count):  # neighbours of a base span are no part of it
        add("logged in from host", f"{seeds['ip']()} {digits(6)}")
    return docs, hidden, decoys
