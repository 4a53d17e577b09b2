"""Typed settings of the stages and the layout of a working folder."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import PurePosixPath

from kgloom.functions import constants as K


@dataclass(frozen=True)
class Layout:
    """Where each stage reads and writes below one folder."""

    root: str

    def at(self, *parts: str) -> str:
        return str(PurePosixPath(self.root, *parts)) if "://" not in self.root else "/".join((self.root.rstrip("/"), *parts))

    @property
    def tables(self) -> str:
        return self.at("structured")

    @property
    def documents(self) -> str:
        return self.at("unstructured", "documents")

    @property
    def sentences(self) -> str:
        return self.at("unstructured", "sentences")


@dataclass(frozen=True)
class FetchConfig:
    page_size: int = 100
    batch_size: int = 20
    sleep_seconds: float = 2.0
    retries: int = 3
    languages: tuple[str, ...] = ("en", "zh")
    hops: int = 2


@dataclass(frozen=True)
class LinkingConfig:
    top_k: int = K.LINK_TOP_K
    multi_token_threshold: float = K.LINK_MULTI
    single_token_threshold: float = K.LINK_SINGLE
    review_threshold: float = K.LINK_REVIEW
    margin_threshold: float = K.LINK_MARGIN
    tfidf_limit: int = K.TFIDF_TOP_K
    anchor_threshold: float = K.ANCHOR_SCORE


@dataclass(frozen=True)
class FeatureConfig:
    use_pos: bool = True
    use_dictionary: bool = True
    use_time_hint: bool = True


@dataclass(frozen=True)
class RelationConfig:
    max_token_distance: int = K.MAX_TOKEN_DISTANCE
    max_sentence_length: int = 128
    position_clip: int = 40
    negative_ratio: float = 3.0
    train_share: float = 0.65
    dev_share: float = 0.2
    threshold: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)
    seed: int = 42


def load(kind: type, path: str | None):
    """Settings from a JSON file; names that the settings don't have are an error, missing ones keep their defaults."""
    if path is None:
        return kind()
    with open(path, encoding="utf-8-sig") as f:
        given = json.load(f)
    unknown = sorted(set(given) - {x.name for x in fields(kind)})
    if unknown:
        raise ValueError(f"{kind.__name__} has no {', '.join(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def as_dict(settings) -> dict:
    return asdict(settings)
