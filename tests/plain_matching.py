"""The matching rule for one document as it reads, unit by unit, to test the joins against."""

from collections import defaultdict

from weft.functions.text import FUZZY_FLOOR, MARGIN, PLACE_WEIGHT, TEXT_WEIGHT


def distance(a: str, b: str) -> int:
    """Edit distance, a column of the table at a time as the bits of two integers."""
    if not a:
        return len(b)
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        at[c] |= 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus, minus = down | (full & ~(across | up)), up & across
        score += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
    return score


def sequential(previous: list[dict], current: list[dict], hints: dict[int, str] | None = None) -> list[dict]:
    """The whole rule for one document, current units in order; every match uses its previous unit up.

    A hint is the stable id that a current unit had when its document was last seen unchanged.
    """
    free = {i: p for i, p in enumerate(previous)}
    by_norm: dict[tuple, list[int]] = defaultdict(list)
    for i, p in enumerate(previous):
        by_norm[p["unit_kind"], p["context"], p["norm"]].append(i)
    out = []
    for at, u in enumerate(current):
        what = lambda kind, i=None, score=None, trusted=False: {
            "doc_id": u["doc_id"], "ordinal": u["ordinal"], "kind": kind, "score": score,
            "previous_ordinal": None if i is None else previous[i]["ordinal"], "stable_id": None if i is None else previous[i]["stable_id"], "trusted_reuse": trusted,
        }
        same = [i for i in by_norm[u["unit_kind"], u["context"], u["norm"]] if i in free]
        hinted = [i for i in same if hints and previous[i]["stable_id"] == hints.get(at)]
        if hinted or len(same) == 1:
            i = (hinted or same)[0]
            p = free.pop(i)
            kind = "exact" if hinted or p["ordinal"] == u["ordinal"] else "moved"
            out.append(what(kind, i, None, bool(p["trusted"]) and p["source"] == u["source"]))
            continue
        if same:
            out.append(what("ambiguous"))
            continue
        scores = []
        for i, p in free.items():
            if (p["unit_kind"], p["context"]) != (u["unit_kind"], u["context"]):
                continue
            place, longest = PLACE_WEIGHT / (1 + abs(p["ordinal"] - u["ordinal"])), max(len(p["norm"]), len(u["norm"]))
            bound = 1 - abs(len(p["norm"]) - len(u["norm"])) / longest if longest else 1.0
            if TEXT_WEIGHT * bound + place >= FUZZY_FLOOR:
                text = 1 - distance(p["norm"], u["norm"]) / longest if longest else 1.0
                if (score := TEXT_WEIGHT * text + place) >= FUZZY_FLOOR:
                    scores.append((-score, p["stable_id"], i))
        scores.sort()
        if not scores:
            out.append(what("new"))
        elif len(scores) > 1 and scores[1][0] - scores[0][0] < MARGIN:
            out.append(what("ambiguous"))
        else:
            free.pop(scores[0][2])
            out.append(what("fuzzy", scores[0][2], -scores[0][0]))
    return out
