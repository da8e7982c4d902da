r"""Format-preserving pseudonyms for personal data, with Spark expressions only.

Candidates are found by one pattern, validated (Luhn sum, real calendar date, octets up to 255, mod 97), and replaced by
a keyed permutation of their own format: a balanced or unbalanced Feistel network over the value's free digits. Equal
values get equal pseudonyms in every document, different values different ones.

    cards      first digit and length stay, the inner digits are permuted, the Luhn digit is computed again
    dates      Y-M-D, D/M/Y and D.M.Y: the day's number within its 400-year cycle is permuted (146097 = 189 * 773)
    IPv4       the 32-bit value is permuted
    phones     +C (AAA) EEE-NNNN and national AAA-EEE-NNNN: all digits but the first of the area and exchange codes
    SSN        AAA-GG-SSSS: all nine digits
    IBAN       digits after the check digits are permuted, the check digits computed again
    emails     letters of the local part as base 26 and its digits as base 10, class by class; the domain's too, save
               its last label
    secrets    hexadecimal, key-like and password values: each digit and letter within its class

Limits: an address has at most 64 characters before its @ and 128 labels of 63 after it, as mail allows; so no text, however
long, makes a pattern look back or call itself without bound. Secrets of any length are permuted in chunks of CHUNK.
The key is a parameter without a default; whoever has it can undo every pseudonym.

Defined cases: a null text stays null; a text without personal data is unchanged, byte for byte; candidates that fail
their validation stay; repeated rows get the same result; other columns are passed through, save that columns named
pii_found or pii_kinds are replaced; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import let

ROUNDS = 8
#: Characters of a secret or address that are permuted together.
CHUNK = 64

#: Kinds in order of precedence where two begin at one place. No pattern has a capturing group.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,63}",
    "secret": r"(?:(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}|\bAKIA[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9]{16,}|(?<![A-Za-z0-9])[0-9a-f]{32,}(?![A-Za-z0-9]))",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])(?<![0-9][.-])(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z]|[.-][0-9])",
}
ANY = "|".join(PATTERNS.values())
#: A cheap necessary condition, so that most texts are scanned once by a plain pattern: every candidate has a digit or an
#: @, but for secrets, of which each alternative begins with its word or prefix, or is 32 letters of hexadecimal.
HINT = r"[0-9@]|AKIA|sk-|gh[pousr]_|[a-f]{32}|[Pp][Aa][Ss][Ss][Ww]|[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Aa][Pp][Ii]|[Pp][Ww][Dd]"


def _prf(key: str, tweak: Column, r: int, value: Column) -> Column:
    """A non-negative 60-bit keyed function of a round and a half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, F.lit(str(r)), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of 0 .. a*b-1 (a and b up to 2^30): halves in Z_a and Z_b take turns at being added to."""

    def turn(r: int):
        if r % 2 == 0:
            return lambda s: F.struct(F.pmod(s["l"] + F.pmod(_prf(key, tweak, r, s["r"]), a), a).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_prf(key, tweak, r, s["l"]), b), b).alias("r"))

    state = F.struct(F.call_function("div", value, b.cast("long")).alias("l"), F.pmod(value, b).cast("long").alias("r"))
    for r in range(ROUNDS):
        state = let(state, turn(r))
    return let(state, lambda s: s["l"] * b + s["r"])


def _power(base: int, n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(base**k).cast("long") for k in range(10 if base == 10 else 6))), (n + 1).cast("int"))


def permute_digits(digits: Column, key: str, tweak: Column) -> Column:
    """A string of decimal digits, permuted in chunks of up to 16; each later chunk is keyed by those before it, each
    earlier one by the original chunks after it only through its length, so the whole is a permutation."""

    def chunk(d: Column, before: Column) -> Column:
        n = F.char_length(d)
        half = F.floor(n / 2).cast("int")
        one = F.when(n == 1, F.pmod(d.cast("int") + F.pmod(_prf(key, F.concat(tweak, before), 0, F.lit("single")), F.lit(10)), F.lit(10)).cast("string"))
        two = F.lpad(feistel(d.cast("long"), _power(10, half), _power(10, n - half), key, F.concat(tweak, before, n.cast("string"))).cast("string"), n, "0")
        return F.when(n == 0, F.lit("")).when(n == 1, one).otherwise(two)

    starts = F.sequence(F.lit(0), F.floor((F.char_length(digits) - 1) / 16).cast("int"))
    parts = F.transform(starts, lambda k: let(F.substring(digits, k * 16 + 1, F.lit(16)), lambda d: chunk(d, F.substring(digits, F.lit(1), k * 16))))
    return F.when(digits == "", digits).otherwise(F.array_join(parts, ""))


def _shift_each(text: Column, key: str, tweak: Column) -> Column:
    """Letters and digits, each within its class: an autokey substitution of each chunk in two sweeps. In the first a
    character shifts by the characters before it, in the second by those after it, so a change anywhere reaches every
    place of the chunk; each sweep can be undone from its fixed end. Chunks after the first are keyed by their number and
    the first's original. Hexadecimal texts stay hexadecimal."""
    alphabet = F.when(text.rlike("^[0-9a-f]+$"), F.lit("0123456789abcdef")).when(text.rlike("^[0-9A-F]+$"), F.lit("0123456789ABCDEF"))
    classes = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def moved(c: Column, alpha: Column, amount: Column) -> Column:
        def within(letters: Column) -> Column:
            n = F.char_length(letters)
            return F.substring(letters, (F.pmod(F.instr(letters, c) - 1 + F.pmod(amount, n), n) + 1).cast("int"), F.lit(1))

        out = F.when(alpha.isNotNull(), within(alpha))
        for letters in classes:
            out = out.when(F.instr(F.lit(letters), c) > 0, within(F.lit(letters)))
        return out.otherwise(c)

    def sweep(s: Column, alpha: Column, told: Column, r: int) -> Column:
        cs = F.filter(F.split(s, ""), lambda c: c != "")
        step = lambda acc, c: F.concat(acc, moved(c, alpha, _prf(key, F.concat(told, F.char_length(acc).cast("string")), r, acc)))
        return F.aggregate(cs, F.lit(""), step)

    def permuted(chunk: Column, alpha: Column, told: Column) -> Column:
        return let(told, lambda t: let(sweep(chunk, alpha, t, 0), lambda s: F.reverse(sweep(F.reverse(s), alpha, t, 1))))

    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))
    told = lambda cs, i: F.when(i == 0, tweak).otherwise(F.concat_ws("/", tweak, i.cast("string"), cs[0]))
    return let(alphabet, lambda alpha: let(chunks, lambda cs: F.array_join(F.transform(cs, lambda c, i: permuted(c, alpha, told(cs, i))), "")))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _poured(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by digits."""
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["s"], F.substring(digits, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k")))
    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step, lambda a: a["s"])


def luhn_sum(digits: Column) -> Column:
    cs = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    each = F.transform(cs, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        n = F.char_length(d)
        body = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), n - 2), key, F.concat(F.lit("card"), F.substring(d, 1, 1))))
        full = let(body, lambda x: F.concat(x, F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _poured(m, full)).otherwise(m)

    return let(_digits(m), of)


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    y, mo, d = (F.when(iso, F.substring(m, *p)).otherwise(F.substring(m, *q)).cast("int") for p, q in (((1, 4), (7, 4)), ((6, 2), (4, 2)), ((9, 2), (1, 2))))
    real = (y >= 1) & F.try_to_date(F.when(iso, m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))), "yyyy-MM-dd").isNotNull() & mo.between(1, 12) & (d >= 1)

    def of(day: Column) -> Column:
        cycle = F.floor(F.datediff(day, F.lit("1600-01-01").cast("date")) / 146097)
        base = F.date_add(F.lit("1600-01-01").cast("date"), (cycle * 146097).cast("int"))
        new = F.date_add(base, feistel(F.datediff(day, base).cast("long"), F.lit(189), F.lit(773), key, F.concat(F.lit("date"), cycle.cast("string"))).cast("int"))
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(m.contains("/"), F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))

    parsed = F.try_to_date(F.when(iso, m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))), "yyyy-MM-dd")
    return F.when(real, let(parsed, of)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        value = (o[0] * 256 + o[1]) * 65536 + o[2] * 256 + o[3]
        dotted = lambda v: F.concat_ws(".", *(F.pmod(F.floor(v / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)))
        return F.when(F.forall(o, lambda x: x <= 255), let(feistel(value, F.lit(65536), F.lit(65536), key, F.lit("ip")), dotted)).otherwise(m)

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), of)


def _phone(m: Column, key: str) -> Column:
    """The last ten digits are the national number; a country code stays."""

    def of(d: Column) -> Column:
        n = F.char_length(d)
        nat = F.substring(d, n - 9, F.lit(10))
        free = lambda x: F.concat(F.substring(x, 2, 2), F.substring(x, 5, 6))
        back = lambda x, p: F.concat(F.substring(x, 1, 1), F.substring(p, 1, 2), F.substring(x, 4, 1), F.substring(p, 3, 6))
        tweak = lambda x: F.concat(F.lit("phone"), F.substring(x, 1, 1), F.substring(x, 4, 1))
        return let(nat, lambda x: _poured(m, F.concat(F.substring(d, F.lit(1), n - 10), back(x, permute_digits(free(x), key, tweak(x))))))

    return let(_digits(m), of)


def _mod97(text: Column) -> Column:
    number = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(number, F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97))


def _iban(m: Column, key: str) -> Column:
    n = F.char_length(m)
    land, bban = F.substring(m, 1, 2), F.substring(m, F.lit(5), n - 4)
    fresh = let(_poured(bban, permute_digits(_digits(bban), key, F.concat(F.lit("iban"), land))), lambda x: F.concat(land, F.lpad((98 - _mod97(F.concat(x, land, F.lit("00")))).cast("string"), 2, "0"), x))
    return F.when((n >= 15) & (_mod97(F.concat(bban, F.substring(m, 1, 4))) == 1), fresh).otherwise(m)


def _email(m: Column, key: str) -> Column:
    stem, tld = F.regexp_extract(m, r"^(.*)(\.[^.]+)$", 1), F.regexp_extract(m, r"^(.*)(\.[^.]+)$", 2)
    at = lambda s: F.concat(_shift_each(F.regexp_extract(s, "^([^@]*)@", 1), key, F.lit("local")), F.lit("@"), _shift_each(F.regexp_extract(s, "@(.*)$", 1), key, F.lit("domain")))
    return F.concat(let(stem, at), tld)


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^((?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?|AKIA|gh[pousr]_|sk-|)(.*)$", 1)
    return F.concat(head, _shift_each(F.substring(m, F.char_length(head) + 1, F.char_length(m)), key, F.lit("secret")))


def pseudonym(match: Column, key: str) -> Column:
    """One found string -> its pseudonym, or itself if it is not valid."""
    whole = lambda k: match.rlike(f"^(?:{PATTERNS[k]})$")
    ssn = F.when(~F.substring(match, 1, 3).isin("000", "666") & (F.substring(match, 1, 1) != "9") & (F.substring(match, 5, 2) != "00") & (F.substring(match, 8, 4) != "0000"), _poured(match, permute_digits(_digits(match), key, F.lit("ssn")))).otherwise(match)
    return (
        F.when(whole("email"), _email(match, key)).when(whole("phone"), _phone(match, key)).when(whole("ip"), _ip(match, key))
        .when(whole("date"), _date(match, key)).when(whole("ssn"), ssn).when(whole("card"), _card(match, key)).when(whole("iban"), _iban(match, key))
        .otherwise(_secret(match, key))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs with `text` rewritten and two columns more: pii_found (candidates that were valid) and pii_kinds (their
    kinds, sorted). Every occurrence is permuted, by its own value."""
    pii = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(f"({ANY})"), F.lit(1)))

    def rewritten(found: Column) -> Column:
        gaps = F.split(F.col(text), ANY, -1)
        fresh = F.transform(found, lambda m: pseudonym(m, key))
        woven = lambda fs, gs: F.concat(F.array_join(F.transform(fs, lambda x, i: F.concat(F.get(gs, i), x)), ""), F.element_at(gs, -1))
        kind = lambda m: F.coalesce(*(F.when(m.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)) for k in ("email", "phone", "ip", "date", "ssn", "card", "iban")), F.lit("secret"))
        changed = lambda fs: F.filter(F.transform(fs, lambda x, i: F.when(x != F.get(found, i), kind(F.get(found, i)))), lambda k: k.isNotNull())
        return let(fresh, lambda fs: let(gaps, lambda gs: F.struct(woven(fs, gs).alias("text"), changed(fs).alias("kinds"))))

    done = let(pii, lambda found: F.when(F.size(F.coalesce(found, F.expr("cast(array() as array<string>)"))) > 0, rewritten(found)))
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("pii_found", "pii_kinds")]
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(text).alias("was"), done.alias("new"))
    return out.select(
        *(F.coalesce("new.text", "was").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns),
        F.coalesce(F.size("new.kinds"), F.lit(0)).cast("long").alias("pii_found"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("new.kinds")), ","), F.lit("")).alias("pii_kinds"),
    )
