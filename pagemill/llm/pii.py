"""Format-preserving pseudonyms for personal data, in SQL functions alone.

What is found and validated is permuted within its own format by a keyed
Feistel network over two unequal halves, so a value has one pseudonym in all
documents and no two values share one:

* card numbers of 13 to 19 digits that pass the Luhn check: all digits but the
  last are permuted and the check digit is made anew;
* social security numbers within the ranges that are assigned;
* North American telephone numbers: area and exchange begin with 2 to 9 and are
  not N11, and stay so. Digits of that shape that are no such number belong to
  nobody; they keep the part that is wrong, the rest is permuted. Other numbers
  that begin with + keep their first three digits;
* IPv4 addresses; IBANs whose check digits are right, which get new ones (the
  country, letters and all but the last 18 digits stay);
* dates, ISO, with slashes and with points: days of the 400 years from 1800,
  which are 27 x 5411, are permuted without any left over. Whether the month
  comes first between slashes depends on the language; a date that can only be
  read the other way is permuted among the days that are so too (the network is
  applied until one comes out).

E-mail addresses, keys with a known beginning, long hexadecimal and base-62
secrets and values that are assigned to a password or token have no numeric
format; a hash under the same key names them, character by character in the
same class. Numbers that fail validation stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns by kind, tried in this order; none can begin inside a word or a number.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "assigned": r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ ]{0,2}[=:][ ]{0,2}[\"']?(?=[A-Za-z_+/.-]{0,64}[0-9])[A-Za-z0-9_+/-][A-Za-z0-9_+/.-]{4,62}[A-Za-z0-9_+/-]",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,64}|xox[abprs]-[A-Za-z0-9-]{10,64}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "base62": r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[a-z0-9]*[A-Z])(?=[A-Z0-9]*[a-z])[A-Za-z0-9]{24,64}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "iso_date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])",
    "slash_date": r"(?<![\w/])\d{2}/\d{2}/\d{4}(?![\w/])",
    "point_date": r"(?<![\w.])\d{2}\.\d{2}\.\d{4}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)",
    "card": r"(?<!\w)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\w)",
}

#: How the kind of a match is told, in the same order.
_WHOLE = {
    "email": "m like '%@%'",
    "assigned": r"m rlike '^(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ ]{0,2}[=:]'",
    "key": "m rlike '^(AKIA|ASIA|gh[pousr]_|[sr]k_|xox[abprs]-|AIza)'",
    "secret": "m rlike '^([0-9a-f]{32,64}|[0-9A-F]{32,64})$' and not m rlike '^[0-9]+$'",
    "base62": "m rlike '^[A-Za-z0-9]{24,64}$' and m rlike '[a-z]'",
    "iban": "m rlike '^[A-Z]{2}[0-9]{2}'",
    "ip": "m rlike '^([0-9]{1,3}[.]){3}[0-9]{1,3}$'",
    "iso_date": "m rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'",
    "slash_date": "m rlike '/'",
    "point_date": "m rlike '^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$'",
    "ssn": "m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'",
    "phone": "m rlike '^[+(]' or m rlike '^(1[ .-]?)?[(]?[0-9]{3}[) .-]' ",
    "card": "true",
}


@dataclass(frozen=True)
class Pseudonyms:
    """``key`` is the secret; who gives none gets no pseudonyms.

    ``month_first`` are the languages in which 03/04/2020 is in March; it is in
    April in all others, and in March where there is no column lang.
    """

    key: str
    rounds: int = 10
    month_first: tuple[str, ...] = ("en",)
    kinds: tuple[str, ...] = tuple(PATTERNS)

    def __post_init__(self):
        if not self.key:
            raise ValueError("pseudonyms need a key")


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _noise(p: Pseudonyms, kind: str, *parts: str) -> str:
    """60 keyed bits for some values, as a bigint; the key is the column ``__key``."""
    text = f"concat_ws('|', __key, {_quoted(kind)}, {', '.join(parts)})"
    return f"cast(conv(substr(sha2({text}, 256), 1, 15), 16, 10) as bigint)"


def _feistel(p: Pseudonyms, kind: str, left: str, right: str, a: str, b: str) -> str:
    """SQL for a struct (l, r): a permutation of l below ``a`` and r below ``b``.

    Rounds add a keyed function of one half to the other, modulo its size; each
    can be undone, whatever the sizes are.
    """
    odd = f"named_struct('l', pmod(s.l + {_noise(p, kind, 'i', 's.r')}, {a}), 'r', s.r)"
    even = f"named_struct('l', s.l, 'r', pmod(s.r + {_noise(p, kind, 'i', 's.l')}, {b}))"
    start = f"named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint))"
    return f"aggregate(sequence(1, {p.rounds}), {start}, (s, i) -> if(i % 2 = 1, {odd}, {even}))"


def _digits(p: Pseudonyms, kind: str, d: str) -> str:
    """SQL for the permuted string of digits ``d``, 2 to 18 of them."""
    n, k = f"length({d})", f"cast(ceil(length({d}) / 2) as int)"
    power = lambda e: f"cast(rpad('1', {e} + 1, '0') as bigint)"
    pair = _feistel(p, f"{kind}", f"substr({d}, 1, {k})", f"substr({d}, {k} + 1)", power(k), power(f"({n} - {k})"))
    return f"element_at(transform(array({pair}), s -> concat(lpad(cast(s.l as string), {k}, '0'), lpad(cast(s.r as string), {n} - {k}, '0'))), 1)"


def _refill(m: str, digits: str) -> str:
    """SQL for ``m`` with its digits replaced, in order, by those of ``digits``."""
    step = "if(c >= '0' and c <= '9' and length(c) = 1, named_struct('o', concat(s.o, substr(s.d, 1, 1)), 'd', substr(s.d, 2)), named_struct('o', concat(s.o, c), 'd', s.d))"
    return f"aggregate(split({m}, ''), named_struct('o', '', 'd', {digits}), (s, c) -> {step}, s -> s.o)"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` is ``value``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _luhn(d: str) -> str:
    """SQL for the Luhn sum of a string of digits, doubled from the last but one."""
    each = f"aggregate(sequence(1, length({d})), 0, (t, i) -> t + case when (length({d}) - i) % 2 = 0 then cast(substr({d}, i, 1) as int) when substr({d}, i, 1) >= '5' then cast(substr({d}, i, 1) as int) * 2 - 9 else cast(substr({d}, i, 1) as int) * 2 end)"
    return each


def _replaced(p: Pseudonyms, kind: str, m: str) -> str:
    """SQL for the pseudonym of a match, or the match where it isn't valid."""
    raw = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "card":
        head = "substr(d, 1, length(d) - 1)"
        made = _let(_digits(p, kind, head), "h", f"concat(h, cast(pmod(10 - {_luhn("concat(h, '0')")} % 10, 10) as string))")
        return _let(raw, "d", f"if({_luhn('d')} % 10 = 0, {_refill(m, made)}, {m})")
    if kind == "phone":
        # 792 areas and exchanges: 200 to 999 without N11
        place = lambda x: f"((cast(substr({x}, 1, 1) as int) - 2) * 99 + cast(substr({x}, 2) as int) - if(substr({x}, 2) > '11', 1, 0))"
        back = lambda x: f"cast({x} div 99 * 100 + 200 + {x} % 99 + if({x} % 99 >= 11, 1, 0) as string)"
        good = lambda x: f"{x} rlike '^[2-9]([02-9][0-9]|1[02-9])$'"
        area, exchange, line = "substr(t, 1, 3)", "substr(t, 4, 3)", "substr(t, 7)"
        whole = _let(_feistel(p, kind, place(area), f"{place(exchange)} * 10000 + cast({line} as int)", "792", "7920000"), "s", f"concat({back('s.l')}, {back('(s.r div 10000)')}, lpad(cast(s.r % 10000 as string), 4, '0'))")
        wrong = _let(_feistel(p, "exchange", place(area), f"cast({line} as int)", "792", "10000"), "s", f"concat({back('s.l')}, {exchange}, lpad(cast(s.r as string), 4, '0'))")
        none = f"concat({area}, {_digits(p, 'area', 'substr(t, 4)')})"
        us = _let("right(d, 10)", "t", f"concat(substr(d, 1, length(d) - 10), if({good(area)}, if({good(exchange)}, {whole}, {wrong}), {none}))")
        other = f"concat(substr(d, 1, 3), {_digits(p, 'number', 'substr(d, 4)')})"
        return _let(raw, "d", f"if({m} rlike '^[+][0-9]+$' and not {m} rlike '^[+]1[0-9]{{10}}$', {_refill(m, other)}, {_refill(m, us)})")
    if kind == "iban":
        # the number with its first four characters last, and letters as 10 to 35
        value = lambda x: f"aggregate(split({x}, ''), 0, (r, c) -> if(c >= 'A', (r * 100 + ascii(c) - 55) % 97, (r * 10 + cast(c as int)) % 97))"
        bare = f"replace({m}, ' ', '')"
        digits = "regexp_replace(substr(d, 5), '[^0-9]', '')"
        new = _let(digits, "g", f"concat(substr(g, 1, length(g) - 18), {_digits(p, kind, 'right(g, 18)')})")
        account = _refill("substr(d, 5)", new)
        checked = _let(account, "u", f"concat(lpad(cast(98 - {value("concat(u, substr(d, 1, 2), '00')")} as string), 2, '0'), u)")
        spaced = f"aggregate(split({m}, ''), named_struct('o', '', 'd', concat(substr(d, 1, 2), {checked})), (s, c) -> if(c = ' ', named_struct('o', concat(s.o, c), 'd', s.d), named_struct('o', concat(s.o, substr(s.d, 1, 1)), 'd', substr(s.d, 2))), s -> s.o)"
        return _let(bare, "d", f"if(length(d) between 15 and 34 and length({digits}) > 1 and {value('concat(substr(d, 5), substr(d, 1, 4))')} = 1, {spaced}, {m})")
    if kind == "ssn":
        # areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999
        area, group, serial = "cast(substr(d, 1, 3) as int)", "cast(substr(d, 4, 2) as int)", "cast(substr(d, 6) as int)"
        valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
        place = f"(if({area} > 666, {area} - 2, {area} - 1) * 99 + {group} - 1)"
        back = "if(s.l div 99 >= 665, s.l div 99 + 2, s.l div 99 + 1)"
        pair = _feistel(p, kind, place, f"{serial} - 1", "88902", "9999")
        made = _let(pair, "s", f"concat_ws('-', lpad(cast({back} as string), 3, '0'), lpad(cast(s.l % 99 + 1 as string), 2, '0'), lpad(cast(s.r + 1 as string), 4, '0'))")
        return _let(raw, "d", f"if({valid}, {made}, {m})")
    if kind == "ip":
        q = [f"cast(element_at(q, {i}) as bigint)" for i in range(1, 5)]
        pair = _feistel(p, kind, f"{q[0]} * 256 + {q[1]}", f"{q[2]} * 256 + {q[3]}", "65536", "65536")
        made = _let(pair, "s", "concat_ws('.', cast(s.l div 256 as string), cast(s.l % 256 as string), cast(s.r div 256 as string), cast(s.r % 256 as string))")
        valid = "forall(q, x -> cast(x as int) < 256 and (x = '0' or x not like '0%'))"
        return _let(f"split({m}, '[.]')", "q", f"if({valid}, {made}, {m})")
    if kind in ("iso_date", "slash_date", "point_date"):
        day = lambda t: _let(_feistel(p, "date", f"datediff({t}, date'1800-01-01') div 5411", f"datediff({t}, date'1800-01-01') % 5411", "27", "5411"), "s", "date_add(date'1800-01-01', cast(s.l * 5411 + s.r as int))")
        # days from the 13th on, among themselves
        late = f"aggregate(sequence(0, 200), t, (x, k) -> if(k > 0 and day(x) > 12, x, {day('x')}))"
        within = "t is not null and t between date'1800-01-01' and date'2199-12-31'"

        def read(how: str, made: str, otherwise: str) -> str:
            return _let(f"cast(try_to_timestamp({m}, '{how}') as date)", "t", f"if({within} and date_format(t, '{how}') = {m}, date_format({made}, '{how}'), {otherwise})")

        if kind != "slash_date":
            return read({"iso_date": "yyyy-MM-dd", "point_date": "dd.MM.yyyy"}[kind], day("t"), m)
        month, first = "MM/dd/yyyy", "dd/MM/yyyy"
        ours = read(month, day("t"), read(first, late, m))
        return f"if(__month_first, {ours}, {read(first, day('t'), read(month, late, m))})"
    if kind == "email":
        name = f"substr(sha2(concat_ws('|', __key, 'name', lower({m})), 256), 1, 12)"
        domain = f"substr(sha2(concat_ws('|', __key, 'domain', lower(substring_index({m}, '@', -1))), 256), 1, 8)"
        return f"concat('u', {name}, '@d', {domain}, '.example')"
    if kind == "assigned":
        return _let(f"regexp_extract({m}, '[=:][ ]{{0,2}}[\"\\']?(.*)$', 1)", "v", f"concat(substr({m}, 1, length({m}) - length(v)), {_named(p, 'v')})")
    if kind == "key":
        return _let(f"regexp_extract({m}, '^(AKIA|ASIA|AIza|gh[a-z]_|[sr]k_live_|[sr]k_test_|xox[a-z]-)', 1)", "b", f"concat(b, {_named(p, f'substr({m}, length(b) + 1)')})")
    return _named(p, m)


def _named(p: Pseudonyms, v: str) -> str:
    """SQL for the name of a secret: hexadecimal digits for such, else the same classes."""
    block = lambda i: f"sha2(concat_ws('|', __key, 'secret', '{i}', lower(v)), 256)"
    hexadecimal = _let(f"substr(concat({block(0)}, {block(1)}), 1, length(v))", "h", "if(v = upper(v), upper(h), h)")
    number = "cast(conv(substr(h, 2 * i - 1, 2), 16, 10) as int)"
    one = f"case when c >= '0' and c <= '9' then substr('0123456789', {number} % 10 + 1, 1) when c >= 'a' and c <= 'z' then substr('abcdefghijklmnopqrstuvwxyz', {number} % 26 + 1, 1) when c >= 'A' and c <= 'Z' then substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', {number} % 26 + 1, 1) else c end"
    classes = _let(f"concat({block(0)}, {block(1)})", "h", f"array_join(transform(sequence(1, length(v)), i -> {_let('substr(v, i, 1)', 'c', one)}), '')")
    return _let(v, "v", f"if(v rlike '^([0-9a-f]{{16,}}|[0-9A-F]{{16,}})$', {hexadecimal}, {classes})")


def pseudonyms(text: str, p: Pseudonyms) -> tuple[Column, Column]:
    """An array of (kind, old, new) of what is found in a text, and the text between.

    Needs the columns ``__month_first`` and ``__key``. Only texts that have a digit or an @ are
    searched, as every kind needs one.
    """
    union = "|".join(f"(?:{PATTERNS[k]})" for k in p.kinds)
    # numbered references count from the first group of the union
    union = union.replace(r"\1", r"\k<s1>").replace(r"\2", r"\k<s2>").replace(r"(?:\d{13,19}|\d{4}([ -])", r"(?:\d{13,19}|\d{4}(?<s1>[ -])").replace(r"|\d{4}([ -])\d{6}", r"|\d{4}(?<s2>[ -])\d{6}")
    quoted = _quoted(union)
    cases = [f"when {_WHOLE[k]} then named_struct('kind', '{k}', 'old', m, 'new', {_replaced(p, k, 'm')})" for k in p.kinds]
    # phones are told from cards by their separators
    body = f"case {' '.join(cases)} end"
    found = f"transform(regexp_extract_all({text}, {quoted}, 0), m -> {body})"
    some = f"{text} rlike '[0-9@]'"
    none = "cast(array() as array<struct<kind: string, old: string, new: string>>)"
    return (
        F.expr(f"case when {some} then {found} else {none} end"),
        F.expr(f"split({text}, {quoted}, -1)"),
    )


def key_column(spark: SparkSession, p: Pseudonyms) -> Column:
    """The key as the value of a subquery over a table of one row.

    Plans, event logs and the user interface name that table's column and never
    its value, as they would that of a literal.
    """
    return spark.sql("select * from values (:key) as held(key)", args={"key": p.key}).scalar()


def pseudonymised(documents: DataFrame, p: Pseudonyms) -> DataFrame:
    """The documents with ``text`` replaced, and ``pii`` with (kind, old, new).

    ``pii`` lists the values that were replaced, in text order. Null texts stay
    null and empty ones empty, with an empty list; an empty table gives an empty
    result. Where two kinds fit at one place, the first in the order of
    ``PATTERNS`` is taken. Rows that repeat are treated alike. Texts are
    searched whole, in a row's own task; time grows with their length. An input
    column named pii is replaced, others pass, whatever their names. ``n_chars``,
    if there is one, is counted anew.
    """
    names = [f"__own{i}" for i in range(len(documents.columns))]
    own = dict(zip(documents.columns, names, strict=True))
    month = F.col(own["lang"]).isin(*p.month_first) if "lang" in own else F.lit(True)
    out = documents.toDF(*names).withColumn("__month_first", F.coalesce(month, F.lit(True))).withColumn("__text", F.col(own["text"]))
    out = out.withColumn("__key", key_column(documents.sparkSession, p))
    found, pieces = pseudonyms("__text", p)
    out = out.withColumn("__found", found)
    joined = F.array_join(F.flatten(F.zip_with(pieces, "__found", lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b["new"], F.lit(""))))), "")
    out = out.withColumn("__new", F.when(F.size("__found") > 0, joined).otherwise(F.col("__text")))
    made = {"text": F.col("__new")}
    if "n_chars" in own:
        made["n_chars"] = F.length("__new").cast(documents.schema["n_chars"].dataType)
    pii = F.coalesce(F.filter("__found", lambda x: x["old"] != x["new"]), F.array().cast("array<struct<kind:string,old:string,new:string>>"))
    return out.select(*(made.get(c, F.col(n)).alias(c) for c, n in own.items() if c != "pii"), pii.alias("pii"))
