"""The rule transliterator once more, as SQL with recursive queries: an account of the rules that shares only their tables with the expressions."""

from __future__ import annotations

from varnika.functions import rules


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_SIGNS = _values([
    *((c, "c", t) for c, t in rules.CONSONANTS.items()), *((c, "g", t) for c, t in rules.SIGNS.items()), *((c, "w", t) for c, t in rules.VOWELS.items()), *((c, "n", t) for c, t in rules.NASALS.items()),
    *((c, "o", t) for c, t in rules.DIGITS.items()), (rules.VIRAMA, "x", ""), (rules.NUKTA_SIGN, "d", ""),
])
_DOTTED = _values({(rules.CONSONANTS[c], t) for c, t in rules.NUKTA.items()})
_OTHER = _values((t, o, cost) for t, (o, cost) in rules.ALTERNATIVES.items())


def spelled(words: str) -> str:
    """A WITH clause that ends in `spelled` (word, s: the texts of its spoken sounds), for a query that gives a column word."""
    return f"""with recursive sig(ch, k, t) as (values {_SIGNS}), dot(t, d) as (values {_DOTTED}), other(t, o, cost) as (values {_OTHER}),
src as (select distinct word from ({words}) where word is not null),
cl as (select word, i, coalesce(k, 'o') as k, coalesce(t, ch) as t from (select word, i, substring(word, i::int, 1) as ch from (select word, unnest(range(1, length(word) + 1)) as i from src)) left join sig using (ch)),
rd as (select word, 0::bigint as i, []::struct(k varchar, t varchar)[] as a from src
  union all select rd.word, cl.i, case
    when cl.k = 'c' then a || [{{'k': 'c', 't': cl.t}}, {{'k': 's', 't': 'a'}}]
    when cl.k = 'g' then (case when a[-1].k = 's' then a[1:len(a) - 1] else a end) || [{{'k': 'v', 't': cl.t}}]
    when cl.k = 'x' then (case when a[-1].k = 's' then a[1:len(a) - 1] else a end)
    when cl.k = 'w' then a || [{{'k': 'v', 't': cl.t}}]
    when cl.k = 'd' then (case when a[-1].k = 's' and len(a) >= 2 then a[1:len(a) - 2] || [{{'k': 'c', 't': coalesce(dot.d, a[-2].t)}}, a[-1]] else a end)
    else a || [{{'k': cl.k, 't': cl.t}}] end
  from rd join cl on cl.word = rd.word and cl.i = rd.i + 1 left join dot on dot.t = a[-2].t),
sounds as (select word, a as x, len(a) as n from rd where i = length(word)),
sp as (select word, x, n, 0::bigint as i, []::struct(k varchar, t varchar)[] as o from sounds
  union all select word, x, n, i + 1, case when x[i + 1].k = 's' and ((i + 1 = n and n > 2) or (coalesce(o[-2].k in ('v', 's'), false) and coalesce(x[i + 2].k = 'c', false) and i + 3 <= n
    and coalesce(x[i + 3].k in ('v', 's'), false) and not (x[i + 3].k = 's' and i + 3 = n))) then o else o || [x[i + 1]] end from sp where i < n),
spelled as (select word, list_transform(o, lambda y: y.t) as s, array_to_string(list_transform(o, lambda y: y.t), '') as latin from sp where i = n)
"""


def k_best(words: str, k: int = 5) -> str:
    """word, guess, cost and rank: up to k spellings with up to two sounds spelled otherwise."""
    return (
        spelled(words)
        + f""", one as (select word, i, o, cost from (select word, unnest(s) as t, unnest(range(1, len(s) + 1)) as i from spelled) join other using (t)),
guesses as (select word, latin as guess, 0 as cost from spelled
  union all select word, array_to_string(s[1:i - 1] || [o] || s[i + 1:], ''), cost from spelled join one using (word)
  union all select p.word, array_to_string(s[1:p.i - 1] || [p.o] || s[p.i + 1:q.i - 1] || [q.o] || s[q.i + 1:], ''), p.cost + q.cost from spelled join one p using (word) join one q on q.word = p.word and p.i < q.i),
least as (select word, guess, min(cost)::int as cost from guesses group by all)
select word, guess, cost, rank from (select *, (row_number() over (partition by word order by cost, guess))::int as rank from least) where rank <= {k}"""
    )
