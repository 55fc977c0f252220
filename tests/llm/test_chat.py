import pytest

from quillspark.llm import chat as op

SCHEMA = "conv_id long, turn long, role string, text string, place string"


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def brute(rows):
    convs = {}
    for c, turn, role, text, _ in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    full = {c: tuple((r, t) for *_, r, t in sorted(v, key=lambda x: x[:3])) for c, v in convs.items()}
    best = {}
    for c in sorted(full):
        best.setdefault(full[c], c)
    maximal = {c for t, c in best.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in best)}
    return sorted((c, len(full[c]), sum(v == full[c] for v in full.values()), render(full[c])) for c in maximal)


ROWS = (
    [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}", "p") for k in range(6)]
    + [(c, k, "user" if k % 2 == 0 else "assistant", f"t{k}", None) for c, n in ((2, 1), (3, 3), (4, 6), (5, 5)) for k in range(n)]
    + [(6, 0, "user", "t0", ""), (6, 1, "assistant", "other", ""), (7, 0, None, None, ""), (7, 1, "user", "x", ""), (8, None, "system", "s", ""), (8, 3, "user", "u", "")]
    + [(9, 0, "user", "same", ""), (9, 0, "user", "same", ""), (10, 0, "user", "same", ""), (None, 0, "user", "t0", ""), (11, 0, "user", "", ""), (12, 5, "user", "t" * 100_000, "")]
)


@pytest.mark.parametrize("most", [op.BROADCAST_KEPT, 0])
def test_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(op, "BROADCAST_KEPT", most)
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = sorted((r["conv_id"], r["n_turns"], r["n_logged"], r["rendered"]) for r in op.format_chats(df).collect())
    assert got == brute(ROWS)


def test_nothing(spark):
    assert op.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
