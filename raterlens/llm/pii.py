"""Format-preserving pseudonyms of personal numbers, dates and addresses, with
DataFrame functions only.

Values are found by patterns and validated (Luhn for cards, mod 97 for IBANs,
octets, calendar dates, allocated SSN ranges). A valid value becomes a vector
of integers, each with its radix (digits, letters, octets, or the two
coordinates of a day number), and a keyed Feistel network permutes the vectors:
in each round the elements at even or odd places are shifted, modulo their
radix, by SHA-256 of the key, the kind, the round and the elements at the other
places. That is a bijection on the values of the format, so equal values get
equal pseudonyms in all documents and different ones stay different. Check
digits are computed anew; separators stay where they were.

A card is a joined number, or digit groups in the shapes of cards with an
issuer's first digits; a number before or after it doesn't hide it, and lists
of years or tables of numbers aren't cards (see _CARD). An IBAN takes the length
of its country, whatever word follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "raterlens-pseudonyms-1"   # a deployment passes its own secret
ROUNDS = 8
EPOCH, DAY_A, DAY_B = "1900-01-01", 269, 271  # 72,899 days: 1900-01-01 to 2099-08-03

# A domain has at most 253 characters, so at most 126 labels before its last.
_EMAIL = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]{1,63}){0,125}"
          r"\.[A-Za-z]{2,}(?![A-Za-z0-9])")
_LEFT, _RIGHT = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban_pattern() -> str:
    """IBANs of the known countries at their length, others at any."""
    known = "|".join(
        f"(?:{c.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
        for n, c in _IBAN_SIZES.items())
    return f"(?:{known})(?![A-Za-z0-9])|[A-Z]{{2}}\\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"


_IBAN = _iban_pattern()
_DATE = r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}"
_IP = r"(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
_SSN = r"\d{3}-\d{2}-\d{4}"
_PHONE = (r"(?:\+?\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|(?:\+?1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}|"
          r"\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}")
_OTHER = rf"(?:{_DATE}|{_IP}|{_SSN}|{_PHONE}){_RIGHT}|[A-Za-z0-9._%+]{{1,64}}@"  # a value of another kind
# Cards are written joined, 4-6-5, 4-6-4, or in groups of four, the last with three more digits. Groups of four count from
# the first to the last that follow each other: a stretch. A short one (up to 7) must not stand in a table, which has
# four more numbers before or after it; a longer one must consist of cards.
_FOUR = rf"[ -](?!{_OTHER})\d{{4}}(?![A-Za-z0-9])"
_NEXT = r"(?<=\G[ -])"  # behind another match, whose groups belong to it
_NUMBERS = r"\d{1,9}[ -]" * 4
_STRETCH = (rf"(?=\d{{4}}(?:[ -]\d{{4}}){{3}}(?!\d))(?:{_NEXT}|(?<!(?<![\d./])\d{{4}}[ -]))"
            rf"(?:(?:{_NEXT}|(?<!{_NUMBERS}))\d{{4}}(?:{_FOUR}){{3,6}}+(?!{_FOUR})"
            rf"(?:[ -](?!{_OTHER})\d{{3}}(?![A-Za-z0-9]))?(?!(?:[ -]\d++){{4}})|\d{{4}}(?:{_FOUR}){{7,}}+)")
_CARD = rf"\d{{13,19}}(?!\d)|\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}}(?!\d)|{_STRETCH}"
# First digits of the issuers, by the length of the number (fixed values); asked for where a number is grouped.
_ISSUERS = {14: "3[0689]", 15: "3[47]", 16: "[456]|35|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)", 19: "[46]"}
_SPANS = "ARRAY<STRUCT<kind: STRING, new: STRING>>"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"

_PATTERNS = [("email", _EMAIL), ("iban", _IBAN), ("date", _DATE), ("ip", _IP), ("ssn", _SSN),
             ("phone", _PHONE), ("card", _CARD)]
PATTERN = "|".join([_EMAIL, _LEFT + "(?:" + "|".join(p for k, p in _PATTERNS if k != "email") + ")" + _RIGHT,
                    _LEFT + r"(?=[+(])(?:" + _PHONE + ")" + _RIGHT])


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _feistel(vec: str, radix: str, tweak: str, key: str) -> str:
    """Keyed permutation of the vectors ``vec`` (array<bigint>) with the
    radices ``radix``."""
    other = "array_join(CAST(filter(x, (w, j) -> j % 2 <> r % 2) AS ARRAY<STRING>), ',')"
    prf = (f"CAST(conv(substr(sha2(concat_ws('|', {_q(key)}, {_q(tweak)}, r, i, {other}), 256), 1, 13), 16, 10) "
           f"AS BIGINT)")
    return (f"aggregate(sequence(1, {ROUNDS}), {vec}, (x, r) -> transform(x, (v, i) -> "
            f"CASE WHEN i % 2 = r % 2 THEN (v + {prf}) % element_at({radix}, i + 1) ELSE v END))")


_DIGITS = "CAST(split(regexp_replace({m}, '[^0-9]', ''), '') AS ARRAY<BIGINT>)"


def _luhn(digits: str, shift: int) -> str:
    """Luhn sum; shift 0: the last digit is the check digit, 1: none is given."""
    return (f"aggregate(transform({digits}, (v, i) -> CASE WHEN (size({digits}) - 1 - i + {shift}) % 2 = 1 "
            f"THEN CASE WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END ELSE v END), 0L, (a, v) -> a + v)")


def _fill(template: str, chars: str, cls: str) -> str:
    """Put the elements of ``chars`` (array<string>), in order, at the
    characters of the template that match the class."""
    return (f"aggregate(split({template}, ''), named_struct('o', '', 'k', 1), (a, c) -> CASE WHEN c rlike '{cls}' "
            f"THEN named_struct('o', concat(a.o, element_at({chars}, a.k)), 'k', a.k + 1) "
            f"ELSE named_struct('o', concat(a.o, c), 'k', a.k) END, a -> a.o)")


def _strings(vec: str) -> str:
    return f"CAST({vec} AS ARRAY<STRING>)"


def _codes(chars: str) -> str:
    """Alphanumeric characters as numbers in their class."""
    return (f"transform({chars}, c -> CAST(CASE WHEN c rlike '[0-9]' THEN ascii(c) - 48 "
            f"WHEN c rlike '[a-z]' THEN ascii(c) - 97 ELSE ascii(c) - 65 END AS BIGINT))")


def _radices(chars: str) -> str:
    return f"transform({chars}, c -> CAST(CASE WHEN c rlike '[0-9]' THEN 10 ELSE 26 END AS BIGINT))"


def _spelt(vec: str, chars: str) -> str:
    return (f"zip_with({vec}, {chars}, (v, c) -> CASE WHEN c rlike '[0-9]' THEN CAST(v AS STRING) "
            f"WHEN c rlike '[a-z]' THEN chr(v + 97) ELSE chr(v + 65) END)")


def _alnum(text: str, tweak: str, key: str) -> str:
    """Letters and digits of a text, permuted by class (array<string>)."""
    chars = f"split(regexp_replace({text}, '[^A-Za-z0-9]', ''), '')"
    return _let("cs", chars, _spelt(_feistel(_codes("cs"), _radices("cs"), tweak, key), "cs"))


def _email(m: str, key: str) -> str:
    local, rest = f"substring_index({m}, '@', 1)", f"substr({m}, instr({m}, '@'))"
    # linked whatever its case: the permutation sees the lower-cased local part
    return f"concat({_let('em', _alnum(f'lower({local})', 'email', key), _fill(f'lower({local})', 'em', '[a-z0-9]'))}, {rest})"


def _mod97(text: str) -> str:
    """Remainder by 97 of an alphanumeric string, letters counting 10 to 35."""
    return (f"aggregate(split({text}, ''), 0L, (a, c) -> CASE WHEN c rlike '[0-9]' THEN (a * 10 + ascii(c) - 48) % 97 "
            f"ELSE (a * 100 + ascii(c) - 55) % 97 END)")


def _iban(m: str, key: str) -> str:
    flat = f"replace({m}, ' ', '')"
    body = f"array_join({_alnum('substr(ib, 5)', 'iban', key)}, '')"
    check = _let("bb", body, "concat(substr(ib, 1, 2), lpad(CAST(98 - " + _mod97(
        "concat(bb, substr(ib, 1, 2), '00')") + " AS STRING), 2, '0'), bb)")
    new = _let("ib", flat, f"split({check}, '')")
    valid = _let("ib", flat, f"{_mod97('concat(substr(ib, 5), substr(ib, 1, 4))')} = 1 AND length(ib) BETWEEN 15 AND 34")
    return f"CASE WHEN {valid} THEN {_let('ni', new, _fill(m, 'ni', '[A-Z0-9]'))} END"


def _date(m: str, key: str) -> str:
    def as_date(fmt):
        return f"CAST(try_to_timestamp({m}, '{fmt}') AS DATE)"

    def one(fmt):
        day = f"CAST(datediff({as_date(fmt)}, DATE'{EPOCH}') AS BIGINT)"
        vec = _let("dn", day, f"CASE WHEN dn BETWEEN 0 AND {DAY_A * DAY_B - 1} THEN array(dn div {DAY_B}, dn % {DAY_B}) END")
        perm = _feistel("dv", f"array({DAY_A}L, {DAY_B}L)", "date", key)
        back = f"date_format(date_add(DATE'{EPOCH}', CAST(nv[0] * {DAY_B} + nv[1] AS INT)), '{fmt}')"
        return _let("dv", vec, f"CASE WHEN dv IS NOT NULL THEN {_let('nv', perm, back)} END")

    return (f"CASE WHEN {m} rlike '^[0-9]{{4}}-' THEN {one('yyyy-MM-dd')} WHEN {m} rlike '^[0-9]{{4}}/' THEN {one('yyyy/MM/dd')} "
            f"WHEN {m} rlike '[.]' THEN {one('dd.MM.yyyy')} "
            f"WHEN substr({m}, 1, 2) <= '12' THEN {one('MM/dd/yyyy')} ELSE {one('dd/MM/yyyy')} END")


def _ip(m: str, key: str) -> str:
    octets = f"CAST(split({m}, '[.]') AS ARRAY<BIGINT>)"
    perm = _feistel("oc", "array(256L, 256L, 256L, 256L)", "ip", key)
    return _let("oc", octets, f"CASE WHEN array_max(oc) <= 255 THEN array_join({_strings(perm)}, '.') END")


def _ssn(m: str, key: str) -> str:
    a, g, s = (f"CAST(substr({m}, {x}, {n}) AS BIGINT)" for x, n in ((1, 3), (5, 2), (8, 4)))
    valid = f"{a} BETWEEN 1 AND 899 AND {a} <> 666 AND {g} > 0 AND {s} > 0"
    vec = f"array({a} - 1 - CAST({a} > 666 AS BIGINT), {g} - 1, {s} - 1)"
    perm = _feistel(vec, "array(898L, 99L, 9999L)", "ssn", key)
    area = "(sv[0] + 1 + CAST(sv[0] >= 665 AS BIGINT))"
    parts = [f"lpad(CAST({x} AS STRING), {n}, '0')" for x, n in ((area, 3), ("sv[1] + 1", 2), ("sv[2] + 1", 4))]
    return f"CASE WHEN {valid} THEN {_let('sv', perm, f'concat_ws(chr(45), {', '.join(parts)})')} END"


def _phone(m: str, key: str) -> str:
    d = _DIGITS.format(m=m)
    # the last ten digits of a North American number: area and exchange start with 2 to 9
    local = "slice(pd, size(pd) - 9, 10)"
    american = "(size(pd) = 10 OR size(pd) = 11 AND pd[0] = 1) AND pd[size(pd) - 10] >= 2 AND pd[size(pd) - 7] >= 2"
    base = "transform(lo, (v, i) -> CASE WHEN i IN (0, 3) THEN v {s} 2 ELSE v END)"
    perm = _feistel(base.format(s="-"), "transform(lo, (v, i) -> CASE WHEN i IN (0, 3) THEN 8L ELSE 10L END)", "phone", key)
    na = (f"concat(slice(pd, 1, size(pd) - 10), {_let('lo', local, _let('lo', perm, base.format(s='+')))})")
    # others keep their first two digits
    tail = "slice(pd, 3, size(pd))"
    other = f"concat(slice(pd, 1, 2), {_let('tl', tail, _feistel('tl', 'transform(tl, v -> 10L)', 'phone+', key))})"
    new = _let("pd", d, f"CASE WHEN {american} THEN {na} WHEN size(pd) BETWEEN 8 AND 15 THEN {other} END")
    return _let("np", f"{new}", f"CASE WHEN np IS NOT NULL THEN {_fill(m, _strings('np'), '[0-9]')} END")


def _card(m: str, key: str) -> str:
    d = _DIGITS.format(m=m)
    perm = _feistel("pl", "transform(pl, v -> 10L)", "card", key)
    check = f"concat(pp, array((10 - {_luhn('pp', 1)} % 10) % 10))"
    new = _let("pl", "slice(cd, 1, size(cd) - 1)", _let("pp", perm, check))
    return _let("cd", d, f"CASE WHEN size(cd) BETWEEN 13 AND 19 AND array_max(cd) > 0 AND {_luhn('cd', 0)} % 10 = 0 "
                         f"THEN {_let('nc', new, _fill(m, _strings('nc'), '[0-9]'))} END")


def _issued(m: str, n: int) -> str:
    return f"replace(replace({m}, ' ', ''), '-', '') rlike '^(?:{_ISSUERS[n]})[0-9]*$'"


def _cards(m: str, key: str) -> str:
    """Text of a match of the card pattern with its cards replaced, and their
    pseudonyms (empty if there is none)."""
    whole, none = _card(m, key), "CAST(array() AS ARRAY<STRING>)"
    grouped = " OR ".join(f"size({_DIGITS.format(m=m)}) = {n} AND {_issued(m, n)}" for n in (14, 15, 19))
    one = (f"CASE WHEN {m} rlike '^[0-9]+$' OR {grouped} THEN "
           + _let("wc", whole, f"CASE WHEN wc IS NOT NULL THEN named_struct('new', wc, 'cards', array(wc)) END") + " END")
    # up to seven groups hold at most one card of 16 digits: the first valid one
    fours = f"(length({m}) + 1) div 5"
    window = f"substr({m}, 5 * i + 1, 19)"
    tried = (f"filter(transform(sequence(0, {fours} - 4), i -> named_struct('i', i, 'new', CASE WHEN {_issued(window, 16)} "
             f"THEN {_let('cw', window, _card('cw', key))} END)), w -> w.new IS NOT NULL)")
    short = _let("tw", tried, f"CASE WHEN size(tw) > 0 THEN named_struct('new', concat(substr({m}, 1, 5 * tw[0].i), tw[0].new, "
                              f"substr({m}, 5 * tw[0].i + 20)), 'cards', array(tw[0].new)) END")
    # longer: all quadruples are cards, or none
    quad = "[0-9]{4}(?:[ -][0-9]{4}){3}"
    plain = _let("dg", _DIGITS.format(m="q"), f"{_luhn('dg', 0)} % 10 = 0")
    quads = f"regexp_extract_all({m}, '{quad}', 0)"
    new = _let("cq", "q", _card("cq", key))
    long = _let("qs", quads, f"CASE WHEN {fours} % 4 = 0 AND forall(qs, q -> {_issued('q', 16)} AND {plain}) THEN "
                + _let("nq", f"transform(qs, q -> {new})", f"named_struct('new', array_join(flatten(zip_with(split({m}, '{quad}', -1), "
                       "nq, (x, y) -> array(coalesce(x, ''), coalesce(y, '')))), ''), 'cards', nq)") + " END")
    stretch = f"{m} rlike '^[0-9]{{4}}[ -][0-9]{{4}}[ -]'"
    # a 16-digit card goes before one of 19
    found = f"CASE WHEN {stretch} AND {fours} > 7 THEN {long} WHEN {stretch} THEN coalesce({short}, {one}) ELSE {one} END"
    return f"coalesce({found}, named_struct('new', {m}, 'cards', {none}))"


def _pseudonym(m: str, key: str) -> str:
    """Text of a match with its values replaced (new), and their kinds and
    pseudonyms (spans; none if it is not valid)."""
    makers = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone}

    def one(kind):
        return _let("pn", makers[kind](m, key), f"named_struct('new', coalesce(pn, {m}), 'spans', CASE WHEN pn IS NULL THEN "
                    f"CAST(array() AS {_SPANS}) ELSE array(named_struct('kind', {_q(kind)}, 'new', pn)) END)")

    cards = _let("ca", _cards(m, key), "named_struct('new', ca.new, 'spans', "
                                       "transform(ca.cards, c -> named_struct('kind', 'card', 'new', c)))")
    cases = " ".join(f"WHEN {m} rlike {_q('^(?:' + p + ')$')} THEN {cards if k == 'card' else one(k)}" for k, p in _PATTERNS)
    return f"CASE {cases} ELSE named_struct('new', {m}, 'spans', CAST(array() AS {_SPANS})) END"


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Texts with their personal values replaced by pseudonyms.

    ``docs`` needs doc_id and text; further columns are ignored. Returns a row
    for every input row: doc_id, text, n_values (values replaced), kinds (their
    distinct kinds, sorted and comma-joined: card, date, email, iban, ip,
    phone, ssn) and spans (kind and pseudonym, in text order).

    Values that fail validation stay as they are, and so does all other text.
    A null text stays null with 0 values, an empty one stays empty; null ids
    and repeated rows pass through; an empty table gives no rows. Dates before
    1900 or after 2099-08-03 are not validated. Of an address whose domain has
    more than 127 labels the first 127 count. The time and memory of a text
    grow in proportion to its length.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.withColumn("hit", F.expr(
        f"CASE WHEN text rlike '[0-9]|@' THEN regexp_extract_all(text, {_q(PATTERN)}, 0) ELSE array() END"))
    named = found.withColumn("sub", F.expr(f"transform(hit, m -> {_pseudonym('m', key)})"))
    whole = F.expr(
        f"CASE WHEN size(hit) > 0 THEN array_join(flatten(zip_with(split(text, {_q(PATTERN)}, -1), "
        "sub.new, (p, s) -> array(coalesce(p, ''), coalesce(s, '')))), '') "
        "ELSE text END")
    spans = F.expr("flatten(sub.spans)")
    return named.select("doc_id", whole.alias("text"), F.coalesce(spans, F.array()).alias("spans")).select(
        "doc_id", "text", F.size("spans").cast("bigint").alias("n_values"),
        F.array_join(F.array_sort(F.array_distinct(F.col("spans.kind"))), ",").alias("kinds"), "spans")
