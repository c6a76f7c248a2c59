"""Pages with planted phrases of policies, for checks and benches: about 45 % decisive, 30 % two supportive signals, 10 % one, 15 % none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.plans.policy import Policy, Signal

#: Characters that compatibility forms fold: planted in their place, so that a matcher without NFKC misses the phrase.
PLAIN, COMPATIBLE = "0123456789", "".join(chr(0xFF10 + d) for d in range(10))


def pools(policy: Policy) -> tuple[list[list[str]], list[list[str]]]:
    """Phrases of each universal decisive and supportive signal that has any; all of them make the signal hold."""

    def phrases(s: Signal) -> list[str]:
        return [*s.spec.phrases, *s.spec.require_all, *(p for g in s.spec.require_all_any for p in g)]

    return [phrases(s) for s in policy.decisive if phrases(s)], [phrases(s) for s in policy.supportive if phrases(s)]


def _pick(groups: Sequence[Sequence[str]], at: Column) -> Column:
    rows = [F.array(*map(F.lit, g)) for g in groups]
    return F.get(F.array(*rows), at % len(rows)) if rows else F.array().cast("array<string>")


def planted(policies: Sequence[Policy], key: str, fold: bool = True) -> Column:
    """The phrases of a page as lines, chosen by a hash of its key."""
    k = F.col(key)
    roll = F.conv(F.substring(F.md5(k.cast("string").cast("binary")), 1, 7), 16, 10).cast("int") % 100
    turn = F.floor(k / len(policies)).cast("int")
    out = F.array().cast("array<string>")
    for i, p in enumerate(sorted(policies, key=lambda p: p.type)):
        decisive, supportive = pools(p)
        two = F.concat(_pick(supportive, turn), _pick(supportive, turn + 1)) if len(supportive) > 1 else _pick(supportive, turn)
        lines = F.when(roll < 45, _pick(decisive, turn)).when(roll < 75, two).when(roll < 85, _pick(supportive, turn)).otherwise(F.array().cast("array<string>"))
        out = F.when(F.pmod(k, F.lit(len(policies))) == i, lines).otherwise(out)
    return F.transform(out, lambda x: F.translate(F.replace(x, F.lit("fi"), F.lit("ﬁ")), PLAIN, COMPATIBLE)) if fold else out


def pages(df: DataFrame, policies: Sequence[Policy], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the rows' own texts as filler, behind the planted lines."""
    return df.select(key, F.array_join(F.concat(planted(policies, key), F.array(F.coalesce(text, F.lit("")))), "\n").alias(text))


def pages_sql(policies: Sequence[Policy], table: str, key: str = "doc_id", text: str = "text") -> str:
    """The same pages as SQL, without the folded characters."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    pick = lambda groups, at: f"([{', '.join('[' + ', '.join(map(quote, g)) + ']' for g in groups)}])[({at}) % {len(groups)} + 1]" if groups else "[]::VARCHAR[]"
    cases = []
    for i, p in enumerate(sorted(policies, key=lambda p: p.type)):
        decisive, supportive = pools(p)
        two = f"list_concat({pick(supportive, 'turn')}, {pick(supportive, 'turn + 1')})" if len(supportive) > 1 else pick(supportive, "turn")
        cases.append(f"WHEN {key} % {len(policies)} = {i} THEN CASE WHEN roll < 45 THEN {pick(decisive, 'turn')} WHEN roll < 75 THEN {two} WHEN roll < 85 THEN {pick(supportive, 'turn')} ELSE [] END")
    rolls = f"SELECT {key}, {text}, {key} // {len(policies)} AS turn, ('0x' || left(md5({key}::VARCHAR), 7))::INT % 100 AS roll FROM {table}"
    return f"SELECT {key}, array_to_string(list_concat(CASE {' '.join(cases)} ELSE [] END, [coalesce({text}, '')]), chr(10)) AS {text} FROM ({rolls})"
