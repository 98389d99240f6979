"""Sets of table contracts, from mappings or YAML."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from .ingest import TableContract

_LISTS = ("required", "optional", "excluded", "melt")
_KEYS = {f.name for f in fields(TableContract)}


@dataclass(frozen=True)
class ContractSet:
    """Contracts by table number, and the version that goes into an ingest signature."""

    version: str
    tables: Mapping[int, TableContract]

    def __getitem__(self, number: int) -> TableContract:
        if number not in self.tables:
            raise KeyError(f"no contract for table {number}; there are {sorted(self.tables)}")
        return self.tables[number]


def _contract(name: str, raw: Mapping, defaults: Mapping) -> TableContract:
    if not isinstance(raw, Mapping):
        raise ValueError(f"{name}: a contract is a mapping")
    given = {**defaults, **raw}
    if unknown := sorted(set(given) - _KEYS):
        raise ValueError(f"{name}: unknown keys {unknown}")
    if lacking := sorted({"number", "family"} - set(given)):
        raise ValueError(f"{name}: lacks {lacking}")
    for key in _LISTS:
        columns = given.get(key) or ()
        if isinstance(columns, str) or not all(isinstance(c, str) for c in columns):
            raise ValueError(f"{name}: {key} is not a list of column names")
        if len(set(columns)) < len(columns):
            raise ValueError(f"{name}: {key} repeats a column")
        given[key] = tuple(columns)
    try:
        return TableContract(**given)
    except ValueError as e:
        raise ValueError(f"{name}: {e}") from e


def contract_set(raw: Mapping) -> ContractSet:
    """Contracts of ``{"version", "defaults", "tables": {name: contract}}``. What a contract does not
    state comes from the defaults. Refused: no tables, a number twice, unknown keys, a column that
    is both excluded and persisted."""
    tables: dict[int, TableContract] = {}
    for name, one in (raw.get("tables") or {}).items():
        contract = _contract(name, one, raw.get("defaults") or {})
        if contract.number in tables:
            raise ValueError(f"{name}: table {contract.number} has a contract already")
        tables[contract.number] = contract
    if not tables:
        raise ValueError("no table contracts")
    return ContractSet(raw.get("version", "unversioned"), tables)


def read_contracts(text: str) -> ContractSet:
    """Contracts from YAML, where a YAML reader is installed."""
    import yaml

    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError("contracts are not YAML") from e
    if not isinstance(raw, Mapping):
        raise ValueError("contracts are a mapping")
    return contract_set(raw)
