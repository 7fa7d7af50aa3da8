"""Scalar functions: name to (least arguments, most arguments, builder of arguments)."""

from __future__ import annotations

from collections.abc import Callable

from granary.functions.base import X, comparable, condition, date, datetime, folded, merged, micros, moment, number, quote, refuse, seconds, small, text, time_text, united, whole

MANY = 99
TABLE: dict[str, tuple[int, int, Callable[..., X]]] = {}


def add(names: str, least: int, most: int, build: Callable[..., X]) -> None:
    for name in names.split():
        TABLE[name] = (least, most, build)


def strings(template: str, kind: str = "str"):
    """All arguments as text."""
    return lambda *a: X(template.format(*map(text, a)), kind)


def numbers(template: str, kind: str = "num"):
    return lambda *a: X(template.format(*map(number, a)), kind)


def finite(sql: str) -> X:
    """NULL for what isn't a number or infinite."""
    return X(f"nullif(nullif(nullif({sql}, double('NaN')), double('Infinity')), double('-Infinity'))", "num")


# text
add("CONCAT", 1, MANY, lambda *a: X(f"concat({', '.join(map(text, a))})", "str"))
add("CONCAT_WS", 2, MANY, lambda s, *a: X(f"IF({text(s)} IS NULL, NULL, concat_ws({text(s)}, {', '.join(map(text, a))}))", "str"))
add("LENGTH OCTET_LENGTH", 1, 1, strings("octet_length({0})", "int"))
add("BIT_LENGTH", 1, 1, strings("bit_length({0})", "int"))
add("CHAR_LENGTH CHARACTER_LENGTH", 1, 1, strings("char_length({0})", "int"))
add("LOWER LCASE", 1, 1, strings("lower({0})"))
add("UPPER UCASE", 1, 1, strings("upper({0})"))
add("LTRIM", 1, 1, strings("ltrim({0})"))
add("RTRIM", 1, 1, strings("rtrim({0})"))


def trim(x: X, what: X, side: X) -> X:
    s, w = text(x), text(what)
    both = lambda held, pattern: f"regexp_replace({held}, {pattern}, '')"
    escaped = f"concat('(?:\\\\Q', {w}, '\\\\E)+')"
    if side.value in ("LEADING", "BOTH"):
        s = both(s, f"concat('^', {escaped})")
    if side.value in ("TRAILING", "BOTH"):
        s = both(s, f"concat({escaped}, '$')")
    return X(f"IF({w} = '', {text(x)}, {s})", "str")


add("TRIM", 3, 3, trim)


def substring(s: X, p: X, n: X | None = None) -> X:
    held, pos = text(s), small(p)
    cut = f"substring({held}, {pos}, {small(n)})" if n else f"substring({held}, {pos})"
    return X(f"CASE WHEN {held} IS NULL OR {pos} IS NULL THEN NULL WHEN {pos} = 0 OR abs({pos}) > char_length({held}) THEN '' ELSE {cut} END", "str")


add("SUBSTRING SUBSTR MID", 2, 3, substring)
add("LEFT", 2, 2, lambda s, n: X(f"left({text(s)}, greatest({small(n)}, 0))", "str"))
add("RIGHT", 2, 2, lambda s, n: X(f"right({text(s)}, greatest({small(n)}, 0))", "str"))
add("REPLACE", 3, 3, lambda s, a, b: X(f"IF({text(a)} = '', {text(s)}, replace({text(s)}, {text(a)}, {text(b)}))", "str"))
add("INSTR", 2, 2, strings("instr(lower({0}), lower({1}))", "int"))
add("LOCATE POSITION", 2, 3, lambda sub, s, p=X("1", "int", 1): X(f"locate(lower({text(sub)}), lower({text(s)}), {small(p)})", "int"))
for side in ("lpad", "rpad"):
    add(side.upper(), 3, 3, lambda s, n, p, side=side: X(f"IF({text(p)} = '' OR {small(n)} < 0, NULL, {side}({text(s)}, {small(n)}, {text(p)}))", "str"))
add("REVERSE", 1, 1, strings("reverse({0})"))
add("REPEAT", 2, 2, lambda s, n: X(f"repeat({text(s)}, least(greatest({small(n)}, 0), 100000))", "str"))
add("SPACE", 1, 1, lambda n: X(f"space(greatest({small(n)}, 0))", "str"))
add("FORMAT", 2, 3, lambda x, d, *_: X(f"format_number(round(CAST({number(x)} AS DECIMAL(38, 10)), {small(d)}), {small(d)})", "str"))


def strcmp(a: X, b: X) -> X:
    x, y = comparable(X(text(a), "str"), X(text(b), "str"))
    return X(f"CASE WHEN {x} < {y} THEN -1 WHEN {x} = {y} THEN 0 WHEN {x} > {y} THEN 1 END", "int")


add("STRCMP", 2, 2, strcmp)
add("ASCII ORD", 1, 1, strings("ascii({0})", "int"))
add("CHAR", 1, MANY, lambda *a: X(f"concat({', '.join(f'char({small(x)})' for x in a)})", "str"))
add("HEX", 1, 1, lambda x: X(f"hex({x.sql if x.kind in ('str', 'null') else whole(x)})", "str"))
add("UNHEX", 1, 1, strings("decode(unhex({0}), 'UTF-8')"))
add("TO_BASE64", 1, 1, strings("base64(CAST({0} AS BINARY))"))
add("FROM_BASE64", 1, 1, strings("decode(try_to_binary({0}, 'base64'), 'UTF-8')"))
add("SHA2", 2, 2, lambda s, n: X(f"sha2({text(s)}, 256)", "str") if n.value in ("256", 256) else refuse("SHA2 knows 256 bits only"))
add("UUID", 0, 0, lambda: X("uuid()", "str"))
add("FIELD", 2, MANY, lambda x, *a: X(f"coalesce(CASE {' '.join(f'WHEN {c[0]} = {c[1]} THEN {k}' for k, c in enumerate((comparable(x, y) for y in a), 1))} END, 0)", "int"))
add("FIND_IN_SET", 2, 2, strings("find_in_set(lower({0}), lower({1}))", "int"))
add("ELT", 2, MANY, lambda n, *a: X(f"CASE {small(n)} {' '.join(f'WHEN {k} THEN {text(x)}' for k, x in enumerate(a, 1))} END", "str"))
add("SUBSTRING_INDEX", 3, 3, lambda s, d, n: X(f"substring_index({text(s)}, {text(d)}, {small(n)})", "str"))


def insert(s: X, p: X, n: X, r: X) -> X:
    held, at, size = text(s), small(p), small(n)
    end = f"IF({size} < 0 OR {at} + {size} > char_length({held}), '', substring({held}, {at} + {size}))"
    return X(f"IF({at} < 1 OR {at} > char_length({held}), {held}, concat(left({held}, {at} - 1), {text(r)}, {end}))", "str")


add("INSERT", 4, 4, insert)
add("QUOTE", 1, 1, lambda s: X(f"coalesce(concat('\\'', replace(replace({text(s)}, '\\\\', '\\\\\\\\'), '\\'', '\\\\\\''), '\\''), 'NULL')", "str"))
# Fixed value: the code of each letter; vowels, H, W and Y have none.
CODES = "01230120022455012623010202"


def soundex(s: X) -> X:
    """The first letter, then codes: H and W aside, equal neighbours fall together; not cut, filled up to four."""
    letters = f"upper(regexp_replace({text(s)}, '[^A-Za-z]', ''))"
    heard = f"concat(left({letters}, 1), regexp_replace(substring({letters}, 2), '[HW]', ''))"
    codes = f"regexp_replace(translate({heard}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{CODES}'), '([0-6])\\\\1+', '$1')"
    out = f"concat(left({letters}, 1), replace(substring({codes}, 2), '0', ''))"
    return X(f"IF({letters} = '', '', rpad({out}, greatest(4, char_length({out})), '0'))", "str")


add("SOUNDEX", 1, 1, soundex)
CI = "IF({flags} LIKE '%c%', '', '(?i)')"


def pattern(p: X, flags: X | None = None) -> str:
    held = text(p)
    if isinstance(p.value, str):
        found = p.value
        for name, java in (("alpha", "Alpha"), ("digit", "Digit"), ("alnum", "Alnum"), ("space", "Space"), ("upper", "Upper"), ("lower", "Lower"), ("punct", "Punct"), ("xdigit", "XDigit")):
            found = found.replace(f"[:{name}:]", rf"\p{{{java}}}")
        held = quote(found)
    return f"concat({CI.format(flags=text(flags)) if flags else quote('(?i)')}, {held})"


add("REGEXP_LIKE", 2, 3, lambda s, p, f=None: X(f"({text(s)} RLIKE {pattern(p, f)})", "bool"))


def regexp_replace(s: X, p: X, r: X, pos: X = X("1", "int", "1"), occ: X = X("0", "int", "0"), f: X | None = None) -> X:
    new = f"replace(replace({text(r)}, '\\\\', '\\\\\\\\'), '$', '\\\\$')"
    if str(occ.value) == "0":
        return X(f"regexp_replace({text(s)}, {pattern(p, f)}, {new}, {small(pos)})", "str")
    if str(pos.value) != "1":
        refuse("REGEXP_REPLACE of one occurrence starts at position 1")
    # what lies before the occurrence is kept by a group that matches the earlier ones
    before = f"concat('^((?:(?s:.*?)(?:', {text(p)}, ')){{', CAST({small(occ)} - 1 AS STRING), '}}(?s:.*?))(?:', {text(p)}, ')')"
    return X(f"regexp_replace({text(s)}, concat('(?i)', {before}), concat('$1', {new}))", "str")


add("REGEXP_REPLACE", 3, 6, regexp_replace)


def regexp_all(s: X, p: X, pos: X, f: X | None) -> str:
    return f"regexp_extract_all(substring({text(s)}, {small(pos)}), {pattern(p, f)}, 0)"


add("REGEXP_SUBSTR", 2, 5, lambda s, p, pos=X("1", "int", 1), occ=X("1", "int", 1), f=None: X(f"get({regexp_all(s, p, pos, f)}, {small(occ)} - 1)", "str"))


def regexp_instr(s: X, p: X, pos: X = X("1", "int", 1), occ: X = X("1", "int", 1), after: X = X("0", "int", 0), f: X | None = None) -> X:
    found = regexp_all(s, p, pos, f)
    start = f"locate(get({found}, {small(occ)} - 1), {text(s)}, {small(pos)})"
    if str(occ.value) != "1":  # the text between the matches, which a split leaves, gives the place
        parts = f"slice(split(substring({text(s)}, {small(pos)}), {pattern(p, f)}), 1, {small(occ)})"
        start = f"({small(pos)} + char_length(array_join({parts}, '')) + char_length(array_join(slice({found}, 1, {small(occ)} - 1), '')))"
    return X(f"CASE WHEN {text(s)} IS NULL OR {text(p)} IS NULL THEN NULL WHEN size({found}) < {small(occ)} THEN 0 ELSE {start} + IF({small(after)} = 1, char_length(get({found}, {small(occ)} - 1)), 0) END", "int")


add("REGEXP_INSTR", 2, 6, regexp_instr)

# numbers
add("ABS", 1, 1, lambda x: X(f"abs({number(x)})", x.kind if x.kind in ("int", "num") else "num"))
add("CEIL CEILING", 1, 1, numbers("CAST(ceil({0}) AS BIGINT)", "int"))
add("FLOOR", 1, 1, numbers("CAST(floor({0}) AS BIGINT)", "int"))
add("SIGN", 1, 1, numbers("CAST(sign({0}) AS INT)", "int"))
add("ROUND", 1, 2, lambda x, d=X("0", "int", 0): X(f"round({number(x)}, {small(d)})", "num"))
add("TRUNCATE", 2, 2, lambda x, d: X(f"(sign({number(x)}) * floor(CAST(abs({number(x)}) AS DECIMAL(38, 10)) * power(10, {small(d)})) / power(10, {small(d)}))", "num"))
add("MOD", 2, 2, numbers("({0} % nullif({1}, 0))"))
add("POW POWER", 2, 2, lambda x, y: finite(f"power({number(x)}, {number(y)})"))
add("EXP", 1, 1, lambda x: finite(f"exp({number(x)})"))
add("SQRT", 1, 1, numbers("IF({0} >= 0, sqrt({0}), NULL)"))
add("LN", 1, 1, numbers("IF({0} > 0, ln({0}), NULL)"))
add("LOG", 1, 2, lambda x, y=None: X(f"IF({number(x)} > 0, ln({number(x)}), NULL)" if y is None else f"IF({number(x)} > 0 AND {number(x)} <> 1 AND {number(y)} > 0, log({number(x)}, {number(y)}), NULL)", "num"))
add("LOG10", 1, 1, numbers("IF({0} > 0, log10({0}), NULL)"))
add("LOG2", 1, 1, numbers("IF({0} > 0, log2({0}), NULL)"))
add("PI", 0, 0, lambda: X("3.141593D", "num"))
for name in "SIN COS TAN ASIN ACOS COT DEGREES RADIANS".split():
    add(name, 1, 1, lambda x, name=name: finite(f"{name.lower()}({number(x)})"))
add("ATAN", 1, 2, lambda x, y=None: X(f"atan({number(x)})" if y is None else f"atan2({number(x)}, {number(y)})", "num"))
add("ATAN2", 2, 2, numbers("atan2({0}, {1})"))
add("RAND", 0, 1, lambda s=None: X(f"rand({small(s) if s else ''})", "num"))


def extreme(name: str):
    def build(*a: X) -> X:
        kind = merged([x.kind for x in a])
        if kind == "str" and any(x.kind != "str" for x in a):
            a = tuple(X(number(x), "num") for x in a) if any(x.kind in ("int", "num") for x in a) else a
            kind = merged([x.kind for x in a])
        items = united(list(a), kind)
        held = f"CAST({name}({', '.join(folded(X(i, 'str')) for i in items)}) AS STRING)" if kind == "str" else f"{name}({', '.join(items)})"
        return X(f"IF({' OR '.join(f'{i} IS NULL' for i in items)}, NULL, {held})", kind)

    return build


add("GREATEST", 2, MANY, extreme("greatest"))
add("LEAST", 2, MANY, extreme("least"))
add("CONV", 3, 3, lambda x, a, b: X(f"conv({text(x)}, {small(a)}, {small(b)})", "str"))

# dates and times
now = "CAST(date_trunc('SECOND', current_timestamp()) AS TIMESTAMP_NTZ)"
add("NOW CURRENT_TIMESTAMP LOCALTIME LOCALTIMESTAMP SYSDATE UTC_TIMESTAMP", 0, 1, lambda *_: X(now, "dt"))
add("CURDATE CURRENT_DATE UTC_DATE", 0, 0, lambda: X("current_date()", "date"))
add("CURTIME CURRENT_TIME UTC_TIME", 0, 1, lambda *_: X(micros(X(now, "dt")), "time"))
add("DATE", 1, 1, lambda x: X(date(x), "date"))
add("TIME", 1, 1, lambda x: X(micros(x), "time"))
add("TIMESTAMP", 1, 2, lambda x, t=None: X(datetime(x) if t is None else f"timestampadd(MICROSECOND, {seconds(t)}, {datetime(x)})", "dt"))
for name, f in {"YEAR": "year", "MONTH": "month", "DAY": "day", "DAYOFMONTH": "day", "DAYOFWEEK": "dayofweek", "DAYOFYEAR": "dayofyear", "QUARTER": "quarter", "WEEKDAY": "weekday", "WEEKOFYEAR": "weekofyear"}.items():
    add(name, 1, 1, lambda x, f=f: X(f"{f}({date(x)})", "int"))
add("LAST_DAY", 1, 1, lambda x: X(f"last_day({date(x)})", "date"))
add("MONTHNAME", 1, 1, lambda x: X(f"date_format({date(x)}, 'MMMM')", "str"))
add("DAYNAME", 1, 1, lambda x: X(f"date_format({date(x)}, 'EEEE')", "str"))


def week(x: X, mode: X = X("0", "int", "0")) -> X:
    """Mode 3 is the ISO week; else weeks begin on Sunday, and days before the year's first Sunday are in week 0."""
    d = date(x)
    return X(f"weekofyear({d})" if str(mode.value) == "3" else f"CAST(floor((dayofyear({d}) + 7 - dayofweek({d})) / 7) AS INT)", "int")


add("WEEK", 1, 2, week)
add("YEARWEEK", 1, 2, lambda x, *_: X(f"(year({date(x)}) * 100 + {week(x).sql})", "int"))
add("TO_DAYS", 1, 1, lambda x: X(f"(datediff({date(x)}, DATE'1970-01-01') + 719528)", "int"))
add("FROM_DAYS", 1, 1, lambda n: X(f"date_add(DATE'1970-01-01', CAST({whole(n)} - 719528 AS INT))", "date"))


def part_of(unit: str, x: X) -> str:
    of_time = {"HOUR": "DIV 3600000000", "MINUTE": "DIV 60000000 % 60", "SECOND": "DIV 1000000 % 60", "MICROSECOND": "% 1000000"}
    if unit in of_time and (x.kind == "time" or (isinstance(x.value, str) and ":" in x.value and "-" not in x.value.lstrip("-"))):
        return f"CAST(abs({micros(x)}) {of_time[unit]} AS INT)"
    if unit == "MICROSECOND":
        return f"CAST(date_format({datetime(x)}, 'SSSSSS') AS INT)"
    if unit in of_time:
        return f"{unit.lower()}({datetime(x)})"
    return f"weekofyear({date(x)})" if unit == "WEEK" else f"{unit.lower()}({date(x)})"


for unit in ("HOUR", "MINUTE", "SECOND", "MICROSECOND"):
    add(unit, 1, 1, lambda x, unit=unit: X(part_of(unit, x), "int"))
add("EXTRACT", 2, 2, lambda unit, x: X(part_of(unit.value, x), "int"))
# What each letter of a date format stands for in Spark's patterns. None: an expression of its own.
LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a"}


def pieces(form: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(form):
        if form[at] == "%" and at + 1 < len(form):
            out.append(("letter", form[at + 1]))
            at += 2
        else:
            out.append(("text", form[at]))
            at += 1
    return out


def date_format(x: X, form: X) -> X:
    if not isinstance(form.value, str):
        refuse("DATE_FORMAT needs its format as a literal")
    d = datetime(x)
    if x.kind == "time":
        d = f"timestampadd(MICROSECOND, {x.sql}, TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    parts = []
    for kind, c in pieces(form.value):
        if kind == "text":
            parts.append(quote(c))
        elif c in LETTERS:
            parts.append(f"date_format({d}, '{LETTERS[c]}')")
        elif c == "D":
            parts.append(f"concat(CAST(day({d}) AS STRING), CASE WHEN day({d}) IN (11, 12, 13) THEN 'th' WHEN day({d}) % 10 = 1 THEN 'st' WHEN day({d}) % 10 = 2 THEN 'nd' WHEN day({d}) % 10 = 3 THEN 'rd' ELSE 'th' END)")
        elif c == "w":
            parts.append(f"CAST(dayofweek({d}) - 1 AS STRING)")
        elif c == "U":
            parts.append(f"format_string('%02d', {week(X(d, 'dt')).sql})")
        elif c in "vu":
            parts.append(f"format_string('%02d', weekofyear({d}))")
        else:
            parts.append(quote(c))
    return X(f"concat({', '.join(parts)})" if parts else "''", "str")


add("DATE_FORMAT", 2, 2, date_format)
add("TIME_FORMAT", 2, 2, lambda x, form: date_format(X(f"(abs({micros(x)}) % 86400000000L)", "time"), form))


def str_to_date(s: X, form: X) -> X:
    if not isinstance(form.value, str):
        refuse("STR_TO_DATE needs its format as a literal")
    java, letters = "", set()
    lenient = LETTERS | {"m": "M", "d": "d", "H": "H", "h": "h", "i": "m", "s": "s"}
    for kind, c in pieces(form.value):
        if kind == "text":
            java += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
        else:
            letters.add(c)
            java += lenient.get(c, c)
    of_day, of_time = letters & set("YymcdeMbWaj"), letters & set("HkhIlisSfpTr")
    held = f"try_to_timestamp({text(s)}, {quote(java)})"
    if of_time and not of_day:
        return X(f"CAST(unix_micros({held}) AS BIGINT)", "time")
    return X(f"CAST({held} AS {'TIMESTAMP_NTZ' if of_time else 'DATE'})", "dt" if of_time else "date")


add("STR_TO_DATE", 2, 2, str_to_date)
add("DATEDIFF", 2, 2, lambda a, b: X(f"datediff({date(a)}, {date(b)})", "int"))


def is_time(x: X) -> bool:
    return x.kind == "time" or (isinstance(x.value, str) and "-" not in x.value.lstrip("-"))


def time_diff(a: X, b: X) -> X:
    if is_time(a):
        return X(f"({seconds(a)} - {seconds(b)})", "time")
    start = lambda x: f"date_trunc('SECOND', {datetime(x)})"
    return X(f"(timestampdiff(SECOND, CAST({start(b)} AS TIMESTAMP_NTZ), CAST({start(a)} AS TIMESTAMP_NTZ)) * 1000000L)", "time")


add("TIMEDIFF", 2, 2, time_diff)


def add_time(sign: str):
    def build(a: X, b: X) -> X:
        if a.kind in ("date", "dt") or (isinstance(a.value, str) and not is_time(a)):
            return X(f"timestampadd(MICROSECOND, {sign}{seconds(b)}, {datetime(a)})", "dt")
        return X(f"({seconds(a)} + {sign}{seconds(b)})", "time")

    return build


add("ADDTIME", 2, 2, add_time(""))
add("SUBTIME", 2, 2, add_time("-"))
add("TIMESTAMPDIFF", 3, 3, lambda u, a, b: X(f"timestampdiff({u.value}, {datetime(a)}, {datetime(b)})", "int"))
DAYS = {"DAY": 1, "WEEK": 7}
MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}


def shift(x: X, amount: X, unit: str, sign: int = 1) -> X:
    """x and so many units: a date stays one where the unit is whole days; a day that a month lacks becomes its last."""
    m, n = moment(x), f"{'-' if sign < 0 else ''}({whole(amount)})"
    if m.kind == "date" and unit in DAYS:
        return X(f"date_add({m.sql}, CAST({n} * {DAYS[unit]} AS INT))", "date")
    if m.kind == "date" and unit in MONTHS:
        return X(f"add_months({m.sql}, CAST({n} * {MONTHS[unit]} AS INT))", "date")
    return X(f"timestampadd({unit}, CAST({n} AS {'BIGINT' if unit == 'MICROSECOND' else 'INT'}), {datetime(m)})", "dt")


add("TIMESTAMPADD", 3, 3, lambda u, n, x: shift(x, n, u.value))
add("UNIX_TIMESTAMP", 0, 1, lambda x=None: X("unix_timestamp()" if x is None else f"CAST(unix_micros(CAST({datetime(x)} AS TIMESTAMP)) DIV 1000000 AS BIGINT)", "int"))


def from_unixtime(t: X, form: X | None = None) -> X:
    held = X(f"CAST(timestamp_seconds({number(t)}) AS TIMESTAMP_NTZ)", "dt")
    return date_format(held, form) if form else held


add("FROM_UNIXTIME", 1, 2, from_unixtime)
add("MAKEDATE", 2, 2, lambda y, n: X(f"IF({small(n)} < 1, NULL, date_add(make_date({small(y)}, 1, 1), {small(n)} - 1))", "date"))


def make_time(h: X, m: X, s: X) -> X:
    a, b, c = whole(h), whole(m), whole(s)
    return X(f"IF({b} BETWEEN 0 AND 59 AND {c} BETWEEN 0 AND 59, IF({a} < 0, -1, 1) * (abs({a}) * 3600 + {b} * 60 + {c}) * 1000000L, NULL)", "time")


add("MAKETIME", 3, 3, make_time)
add("SEC_TO_TIME", 1, 1, lambda n: X(f"({whole(n)} * 1000000L)", "time"))
add("TIME_TO_SEC", 1, 1, lambda x: X(f"({micros(x)} DIV 1000000)", "int"))
add("CONVERT_TZ", 3, 3, lambda x, *_: X(datetime(x), "dt"))


# choices
def choose(c: X, a: X, b: X) -> X:
    kind = merged([a.kind, b.kind])
    x, y = united([a, b], kind)
    return X(f"IF({condition(c)}, {x}, {y})", kind)


def coalesce(*a: X) -> X:
    kind = merged([x.kind for x in a])
    return X(f"coalesce({', '.join(united(list(a), kind))})", kind)


def nullif(a: X, b: X) -> X:
    x, y = comparable(a, b)
    return X(f"CASE WHEN {x} = {y} THEN NULL ELSE {a.sql} END", a.kind)


add("IF", 3, 3, choose)
add("IFNULL NVL", 2, 2, coalesce)
add("COALESCE", 1, MANY, coalesce)
add("NULLIF", 2, 2, nullif)
add("ISNULL", 1, 1, lambda x: X(f"({x.sql} IS NULL)", "bool"))


# JSON: documents are texts
def as_json(x: X) -> str:
    """A value as JSON text."""
    if x.kind == "null":
        return "'null'"
    if x.kind == "bool":
        return f"IF({x.sql}, 'true', 'false')"
    if x.kind in ("int", "num"):
        return f"coalesce(CAST({x.sql} AS STRING), 'null')"
    if x.kind == "json":
        return f"coalesce({x.sql}, 'null')"
    return f"coalesce(substring(to_json(array({text(x)})), 2, char_length(to_json(array({text(x)}))) - 2), 'null')"


def json_extract(doc: X, *paths: X) -> X:
    """Texts keep their quotes; several paths give an array."""
    one = lambda p: f"to_json(try_variant_get(try_parse_json({text(doc)}), {text(p)}, 'variant'))"
    if len(paths) == 1:
        return X(one(paths[0]), "json")
    return X(f"concat('[', concat_ws(',', {', '.join(map(one, paths))}), ']')", "json")


add("JSON_EXTRACT", 2, MANY, json_extract)
add("JSON_UNQUOTE", 1, 1, lambda x: X(f"IF({x.sql} LIKE '\"%', get_json_object(concat('{{\"v\":', {x.sql}, '}}'), '$.v'), {x.sql})", "str"))
add("JSON_OBJECT", 0, MANY, lambda *a: X("concat('{', concat_ws(',', " + ", ".join(f"concat({as_json(X(text(k), 'str'))}, ':', {as_json(v)})" for k, v in zip(a[::2], a[1::2])) + "), '}')" if a else "'{}'", "json"))
add("JSON_ARRAY", 0, MANY, lambda *a: X(f"concat('[', concat_ws(',', {', '.join(map(as_json, a))}), ']')" if a else "'[]'", "json"))


def json_length(doc: X, path: X | None = None) -> X:
    held = json_extract(doc, path).sql if path else text(doc)
    return X(f"CASE WHEN {held} IS NULL THEN NULL WHEN ltrim({held}) LIKE '[%' THEN json_array_length({held}) WHEN ltrim({held}) LIKE '{{%' THEN size(json_object_keys({held})) ELSE 1 END", "int")


add("JSON_LENGTH", 1, 2, json_length)
add("JSON_VALID", 1, 1, lambda x: X(f"IF({x.sql} IS NULL, NULL, try_parse_json({text(x)}) IS NOT NULL)", "bool"))
add("JSON_KEYS", 1, 1, lambda x: X(f"to_json(json_object_keys({text(x)}))", "json"))


def json_type(x: X) -> X:
    held = f"schema_of_variant(try_parse_json({text(x)}))"
    return X(f"CASE WHEN {held} LIKE 'OBJECT%' THEN 'OBJECT' WHEN {held} LIKE 'ARRAY%' THEN 'ARRAY' WHEN {held} = 'BIGINT' THEN 'INTEGER' WHEN {held} LIKE 'DECIMAL%' OR {held} = 'DOUBLE' THEN 'DOUBLE' WHEN {held} = 'VOID' THEN 'NULL' ELSE {held} END", "str")


add("JSON_TYPE", 1, 1, json_type)
add("JSON_QUOTE", 1, 1, lambda x: X(as_json(X(text(x), "str")), "str"))


def json_contains(doc: X, item: X) -> X:
    """Whether an array holds the value, or the document is it."""
    held, wanted = text(doc), f"to_json(try_parse_json({text(item)}))"
    return X(f"IF(ltrim({held}) LIKE '[%', array_contains(transform(from_json({held}, 'array<variant>'), v -> to_json(v)), {wanted}), to_json(try_parse_json({held})) = {wanted})", "bool")


add("JSON_CONTAINS", 2, 2, json_contains)
for name in ("MD5", "SHA", "SHA1"):
    add(name, 0, MANY, lambda *_, name=name: refuse(f"{name} isn't supported; use SHA2(x, 256)"))
add("SLEEP", 1, 1, lambda *_: X("0", "int"))
add("BENCHMARK", 2, 2, lambda *_: X("0", "int"))


def cast(x: X, kind: str, args: list[int]) -> X:
    if kind in ("SIGNED", "INT", "INTEGER", "BIGINT"):
        return X(f"CAST(round({number(x)}) AS BIGINT)", "int")
    if kind == "UNSIGNED":
        n = f"CAST(round({number(x)}) AS DECIMAL(20, 0))"
        return X(f"IF({n} < 0, {n} + 18446744073709551616, {n})", "num")
    if kind in ("DECIMAL", "DEC", "NUMERIC"):
        return X(f"CAST({number(x)} AS DECIMAL({min(args[0], 38) if args else 10}, {args[1] if len(args) > 1 else 0}))", "num")
    if kind in ("DOUBLE", "FLOAT", "REAL"):
        return X(f"CAST({number(x)} AS DOUBLE)", "num")
    if kind in ("CHAR", "NCHAR", "BINARY", "VARCHAR", "TEXT"):
        return X(f"left({text(x)}, {args[0]})" if args else text(x), "str")
    if kind == "DATE":
        return X(date(x), "date")
    if kind in ("DATETIME", "TIMESTAMP"):
        return X(datetime(x), "dt")
    if kind == "TIME":
        return X(micros(x), "time")
    if kind == "YEAR":
        return X(f"CAST({number(x)} AS INT)", "int")
    if kind == "JSON":
        return X(f"to_json(try_parse_json({text(x)}))", "json")
    refuse(f"CAST to {kind} isn't supported")


__all__ = ["TABLE", "cast", "shift", "time_text"]
