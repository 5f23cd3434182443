"""Policies: which entity types are replaced, and by what."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """``placeholders`` maps a type to its template; ``extras`` keeps metadata no operator reads."""

    name: str
    placeholders: dict[str, str]
    description: str = ""
    retain_days: int | None = None
    unstorable: frozenset[str] = field(default_factory=frozenset)

    def template(self, entity_type: Column) -> Column:
        """The template of a type, null without an entry."""
        if not self.placeholders:
            return F.lit(None).cast("string")
        literal = F.create_map(*[F.lit(x) for kv in self.placeholders.items() for x in kv])
        return F.try_element_at(literal, entity_type)

    def covers(self, entity_type: Column) -> Column:
        return entity_type.isin(list(self.placeholders)) if self.placeholders else F.lit(False)


def _stems(**stems: str) -> dict[str, str]:
    return {k: f"[{v}_{{i}}]" for k, v in stems.items()}


# The built-in policies, types and placeholder stems in their order.
BUILT_IN = {
    p.name: p
    for p in (
        Policy("default_pii", _stems(EMAIL="EMAIL", PHONE="PHONE", PERSON="NAME", IP_ADDRESS="IP", CREDIT_CARD="CC", SSN="SSN")),
        Policy("gdpr_strict", _stems(EMAIL="EMAIL", PHONE="PHONE", PERSON="PERSON", IP_ADDRESS="IP", CREDIT_CARD="PAYMENT", SSN="ID")),
        Policy("slm_local", _stems(EMAIL="EMAIL", PHONE="PHONE", PERSON="USER", IP_ADDRESS="ADDR", CREDIT_CARD="CARD", SSN="ID")),
        Policy(
            "hipaa_phi",
            _stems(
                PERSON="PATIENT", EMAIL="CONTACT", PHONE="PHONE", LOCATION="LOC", DOB="DATE", DATE_TIME="DATE", SSN="ID", MRN="MRN", HEALTH_PLAN_ID="PLAN",
                BANK_ACCOUNT="ACCT", DRIVERS_LICENSE="LIC", PASSPORT="PASS", VEHICLE_ID="VEH", DEVICE_ID="DEV", URL="URL", IP_ADDRESS="IP", BIOMETRIC="BIO", PHOTO_REF="PHOTO",
            ),
            retain_days=2555,
        ),
        Policy(
            "pci_dss",
            {
                **_stems(CREDIT_CARD="PAN", PERSON="CARDHOLDER", SERVICE_CODE="SC", CARD_EXPIRY="EXP"),
                **dict.fromkeys(("CVV", "PIN", "MAGNETIC_STRIPE"), "[REDACTED]"),
                **_stems(EMAIL="EMAIL", PHONE="PHONE", LOCATION="ADDR", SSN="SSN", TRANSACTION_ID="TXN", IP_ADDRESS="IP"),
            },
            retain_days=365,
            unstorable=frozenset({"CVV", "PIN", "MAGNETIC_STRIPE"}),
        ),
    )
}


def load_policy(name_or_path: str) -> Policy:
    """A built-in policy by name, else a YAML file; a missing one raises ``FileNotFoundError``."""
    if name_or_path in BUILT_IN:
        return BUILT_IN[name_or_path]
    path = Path(name_or_path)
    if not path.is_file():
        raise FileNotFoundError(f"no policy named or stored at {name_or_path!r}")
    import yaml

    data = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    entities = data.get("entities") or {}
    return Policy(
        str(data.get("name", path.stem)),
        {t: (e or {}).get("placeholder", f"[{t}_{{i}}]") for t, e in entities.items() if e},
        str(data.get("description", "")),
        ((data.get("audit") or {}).get("retain_days")),
        frozenset(t for t, e in entities.items() if isinstance(e, dict) and e.get("storage_allowed") is False),
    )


def list_policies() -> list[str]:
    return sorted(BUILT_IN)


def validate_policy(policy: Policy) -> list[str]:
    """What is wrong with a policy; empty if nothing is."""
    problems = [] if policy.placeholders else ["no entities"]
    problems += [f"{t}: empty placeholder" for t, p in policy.placeholders.items() if not p]
    return problems
