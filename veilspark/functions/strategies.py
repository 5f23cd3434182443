"""Value strategies: what a found value is replaced by."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

STRUCTURAL = "@.-_:/() "


class Strategy(str, Enum):
    PLACEHOLDER = "placeholder"
    HASH = "hash"
    MASK = "mask"
    ENCRYPT = "encrypt"
    SYNTHETIC = "synthetic"


def hash_value(value: Column, algorithm: str = "sha256", salt: str = "", truncate: int = 0) -> Column:
    """Hex digest of salt + value by sha256, sha512 or md5; the first ``truncate`` digits (0: all)."""
    salted = F.concat(F.lit(salt), value)
    if algorithm not in ("sha256", "sha512", "md5"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    digest = F.md5(salted) if algorithm == "md5" else F.sha2(salted, 512 if algorithm == "sha512" else 256)
    return F.substring(digest, 1, truncate) if truncate else digest


def mask_simple(value: Column, first: int = 0, last: int = 0, mark: str = "*") -> Column:
    """Reveals the first and last characters; a value no longer than both is masked whole."""
    n = F.length(value)
    shown = F.concat(F.substring(value, 1, first), F.repeat(F.lit(mark), n - first - last), F.substring(value, n - last + 1, F.lit(last)))
    return F.when(n <= first + last, F.repeat(F.lit(mark), n)).otherwise(shown)


def mask_structured(value: Column, first: int = 0, last: int = 0, mark: str = "*") -> Column:
    """Keeps structural characters; of the others reveals the first and last. Too short a value is shown whole."""
    structural = lambda c: F.lit(STRUCTURAL).contains(c)
    plain = lambda chars: F.size(F.filter(chars, lambda c: ~structural(c)))

    def masked(chars: Column, total: Column) -> Column:
        def shown(c: Column, i: Column) -> Column:
            rank = plain(F.slice(chars, 1, i + 1))
            return F.when(structural(c) | (rank <= first) | (rank > total - last), c).otherwise(F.lit(mark))

        return F.when(total <= first + last, value).otherwise(F.array_join(F.transform(chars, shown), ""))

    done = let(F.split(value, "", -1), lambda chars: let(plain(chars), lambda total: masked(chars, total)))
    return F.when(F.length(value) == 0, value).otherwise(done)


def encrypt_value(value: Column, key: Column) -> Column:
    """Base64 of AES-GCM under a 16, 24 or 32 byte key; random nonce, reversible by ``decrypt_value``."""
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def decrypt_value(token: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(token), key, F.lit("GCM")).cast("string")


# What synthetic values are put together from.
FIRST_NAMES = ("Alex", "Blair", "Casey", "Drew", "Ellis", "Frankie", "Gray", "Harper", "Indigo", "Jules", "Kai", "Logan", "Morgan", "Noel", "Oakley", "Parker")
LAST_NAMES = ("Arden", "Birch", "Cole", "Dane", "Ember", "Field", "Grove", "Hale", "Ivory", "Jarvis", "Keen", "Lake", "Moss", "North", "Oak", "Penn")
DOMAINS = ("example.com", "example.org", "example.net")
STREETS, CITIES = ("Ash Lane", "Brook Road", "Cedar Street", "Dell Close", "Elm Avenue", "Fern Way"), ("Northfield", "Easton", "Southwick", "Weston", "Midvale")
STATES, COUNTRIES, COMPANIES = ("Aland", "Borea", "Cania", "Doria"), ("Arcadia", "Belmora", "Cascara", "Delvia"), ("Alder Works", "Birch Supply", "Cedar Systems", "Dune Trading")
#: Other names of types that have synthetic values.
ALIASES = {"NAME": "PERSON", "PHONE_NUMBER": "PHONE", "EMAIL_ADDRESS": "EMAIL", "IP": "IP_ADDRESS", "IPV4": "IP_ADDRESS", "ORGANIZATION": "COMPANY", "POSTCODE": "ZIP_CODE"}


def synthetic_value(entity_type: Column, value: Column) -> Column:
    """A made-up value of the same kind; equal values give equal results, by the first 8 hex digits of their md5."""
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    entity_type = F.coalesce(F.try_element_at(known, entity_type), entity_type)
    seed = F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")

    def pick(options: tuple[str, ...], step: int) -> Column:
        at = F.pmod(F.floor(seed / F.lit(step)).cast("bigint"), F.lit(len(options))).cast("int")
        return F.get(F.array(*[F.lit(o) for o in options]), at)

    digits = lambda width, step: F.lpad(F.pmod(F.floor(seed / F.lit(step)).cast("bigint"), F.lit(10**width)).cast("string"), width, "0")
    first, last = pick(FIRST_NAMES, 1), pick(LAST_NAMES, 16)
    octet = lambda step: F.pmod(F.floor(seed / F.lit(step)).cast("bigint"), F.lit(254)).cast("string")
    return (
        F.when(entity_type == "PERSON", F.concat_ws(" ", first, last))
        .when(entity_type == "EMAIL", F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@"), pick(DOMAINS, 256)))
        .when(entity_type == "PHONE", F.concat(F.lit("555-01"), digits(2, 7), F.lit("-"), digits(4, 3)))
        .when(entity_type == "IP_ADDRESS", F.concat_ws(".", F.lit("10"), octet(1), octet(251), octet(63001)))
        .when(entity_type == "SSN", F.concat(F.lit("900-"), digits(2, 7), F.lit("-"), digits(4, 3)))
        .when(entity_type == "CREDIT_CARD", F.concat(F.lit("4000-0000-"), digits(4, 3), F.lit("-"), digits(4, 30011)))
        .when(entity_type == "ADDRESS", F.concat_ws(" ", (F.pmod(seed, F.lit(199)) + 1).cast("string"), pick(STREETS, 7)))
        .when(entity_type == "CITY", pick(CITIES, 3))
        .when(entity_type == "STATE", pick(STATES, 3))
        .when(entity_type == "COUNTRY", pick(COUNTRIES, 3))
        .when(entity_type == "COMPANY", pick(COMPANIES, 3))
        .when(entity_type == "ZIP_CODE", digits(5, 3))
        .when(entity_type == "IPV6", F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.pmod(seed, F.lit(65536)))), F.lit(":"), F.lower(F.hex(F.pmod(F.floor(seed / 65536).cast("bigint"), F.lit(65536))))))
        .otherwise(F.concat(F.lit("synthetic-"), F.substring(F.md5(value), 1, 8)))
    )


def apply_strategy(strategy: str | Strategy, entity_type: Column, value: Column, placeholder: Column, key: Column | None = None) -> Column:
    """The replacement of a value under a strategy, for use in place of a placeholder."""
    chosen = Strategy(strategy)
    if chosen is Strategy.HASH:
        return hash_value(value)
    if chosen is Strategy.MASK:
        return mask_structured(value)
    if chosen is Strategy.ENCRYPT:
        if key is None:
            raise ValueError("the encrypt strategy needs a key")
        return encrypt_value(value, key)
    if chosen is Strategy.SYNTHETIC:
        return synthetic_value(entity_type, value)
    return placeholder
