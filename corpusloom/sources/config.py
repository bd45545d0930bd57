"""Run configurations: YAML with typed defaults, checked before any job starts.

Every setting names its place in the file (sections joined by dots).  A file with
a place that its kind of run doesn't know is an error, and so is a value that the
run doesn't support; an empty value is the default.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any, TypeVar

from corpusloom.functions.labels import LABELS

try:
    import yaml
except ImportError:  # JSON configurations still work
    yaml = None

C = TypeVar("C")


def _at(place: str, default: Any) -> Any:
    """A setting with its place in the file."""
    if isinstance(default, list):
        return field(default_factory=lambda: list(default), metadata={"at": place})
    return field(default=default, metadata={"at": place})


@dataclass(frozen=True)
class _Run:
    """What every run has: where its splits are and where its reports go."""

    train_path: str = _at("data.train_path", "")
    dev_path: str = _at("data.dev_path", "")
    text_column: str = _at("data.text_column", "processed_text")
    target_column: str = _at("data.target_column", "macro_label")
    labels: list[str] = _at("labels.order", LABELS)
    output_dir: str = _at("output.report_dir", "reports")


@dataclass(frozen=True)
class BaselineConfig(_Run):
    """The TF-IDF and logistic regression run."""

    prefix: str = _at("output.prefix", "baseline")
    lowercase: bool = _at("features.lowercase", False)
    sublinear_tf: bool = _at("features.sublinear_tf", True)
    word_ngrams: list[int] = _at("features.word.ngram_range", [1, 2])
    word_min_df: int = _at("features.word.min_df", 2)
    char_analyzer: str = _at("features.char.analyzer", "char_wb")
    char_ngrams: list[int] = _at("features.char.ngram_range", [3, 5])
    char_min_df: int = _at("features.char.min_df", 2)
    c: float = _at("model.C", 4.0)
    max_iter: int = _at("model.max_iter", 2000)
    solver: str = _at("model.solver", "lbfgs")
    seed: int = _at("model.random_state", 42)


@dataclass(frozen=True)
class InferenceConfig(_Run):
    """A run of a text model behind a provider."""

    prefix: str = _at("output.prefix", "llm")
    provider: str = _at("provider.name", "openai_chat_completions")
    model: str = _at("provider.model", "")
    api_base: str = _at("provider.api_base", "")
    api_key_env: str = _at("provider.api_key_env", "")
    timeout_seconds: float = _at("provider.timeout_seconds", 60.0)
    max_retries: int = _at("provider.max_retries", 2)
    price_in: float | None = _at("provider.input_price_per_1m_tokens", None)
    price_out: float | None = _at("provider.output_price_per_1m_tokens", None)
    temperature: float = _at("inference.temperature", 0.0)
    max_completion_tokens: int = _at("inference.max_completion_tokens", 2048)
    batch_size: int = _at("inference.batch_size", 25)
    few_shot_examples_per_class: int = _at("few_shot.examples_per_class", 2)


@dataclass(frozen=True)
class HardSubsetConfig(InferenceConfig):
    """A run of a text model over the rows that earlier models confused."""

    classical_predictions: str = _at("artifacts.classical_predictions_path", "")
    llm_predictions: str = _at("artifacts.gemini_predictions_path", "")


@dataclass(frozen=True)
class EncoderConfig(_Run):
    """A fine-tuning run; the trainer is pluggable."""

    prefix: str = _at("output.prefix", "encoder")
    checkpoint_dir: str = _at("output.checkpoint_dir", "")
    model: str = _at("model.name_or_path", "")
    num_labels: int = _at("model.num_labels", 4)
    max_length: int = _at("model.max_length", 128)
    batch_size: int = _at("training.batch_size", 32)
    eval_batch_size: int = _at("training.eval_batch_size", 64)
    learning_rate: float = _at("training.learning_rate", 2e-5)
    weight_decay: float = _at("training.weight_decay", 0.01)
    epochs: int = _at("training.num_epochs", 5)
    warmup_ratio: float = _at("training.warmup_ratio", 0.1)
    gradient_accumulation_steps: int = _at("training.gradient_accumulation_steps", 1)
    max_grad_norm: float = _at("training.max_grad_norm", 1.0)
    num_workers: int = _at("training.num_workers", 0)
    optimizer: str = _at("optimizer.type", "adamw_torch")
    scheduler: str = _at("scheduler.type", "linear_with_warmup")
    metric: str = _at("early_stopping.metric", "eval_macro_f1")
    mode: str = _at("early_stopping.mode", "max")
    patience: int = _at("early_stopping.patience", 2)
    min_delta: float = _at("early_stopping.min_delta", 0.001)
    loss: str = _at("loss.type", "cross_entropy")
    class_weights: str = _at("loss.class_weights", "none")
    seed: int = _at("seed", 42)
    deterministic_algorithms: bool = _at("reproducibility.deterministic_algorithms", True)
    cudnn_deterministic: bool = _at("reproducibility.cudnn_deterministic", True)
    cudnn_benchmark: bool = _at("reproducibility.cudnn_benchmark", False)


def _places(node: dict[str, Any], under: str = "") -> dict[str, Any]:
    """Values by their place."""
    out: dict[str, Any] = {}
    for key, value in node.items():
        out |= _places(value, f"{under}{key}.") if isinstance(value, dict) else {f"{under}{key}": value}
    return out


def load(path: str | Path, kind: type[C]) -> C:
    """The checked configuration in a YAML or JSON file."""
    text = Path(path).read_text(encoding="utf-8")
    data = json.loads(text) if Path(path).suffix == ".json" or yaml is None else yaml.safe_load(text)
    given = _places(data or {})
    known = {f.metadata["at"]: f for f in fields(kind)}
    unknown = sorted(given.keys() - known.keys())
    if unknown:
        raise ValueError(f"{kind.__name__} has no setting {', '.join(unknown)}")
    values = {known[at].name: float(v) if "float" in str(known[at].type) and isinstance(v, int) else v for at, v in given.items() if v is not None}
    return check(kind(**values))


def check(config: C) -> C:
    """``config`` if every setting is one that is supported, else an error naming all that aren't."""
    rules: dict[str, bool] = {"labels": sorted(config.labels) == sorted(LABELS)}
    if isinstance(config, BaselineConfig):
        ranged = lambda r: len(r) == 2 and 1 <= r[0] <= r[1]
        rules |= {
            "sublinear_tf": config.sublinear_tf, "char_analyzer": config.char_analyzer == "char_wb", "solver": config.solver == "lbfgs",
            "word_ngrams": ranged(config.word_ngrams), "char_ngrams": ranged(config.char_ngrams), "c": config.c > 0,
        }
    if isinstance(config, InferenceConfig):
        rules |= {"batch_size": config.batch_size >= 1, "max_retries": config.max_retries >= 0, "few_shot_examples_per_class": config.few_shot_examples_per_class >= 1}
    if isinstance(config, EncoderConfig):
        rules |= {
            "num_labels": config.num_labels == len(config.labels), "optimizer": config.optimizer == "adamw_torch", "scheduler": config.scheduler == "linear_with_warmup",
            "loss": config.loss == "cross_entropy", "class_weights": config.class_weights in ("none", "balanced"), "metric": config.metric == "eval_macro_f1",
            "mode": config.mode in ("max", "min"), "gradient_accumulation_steps": config.gradient_accumulation_steps >= 1, "warmup_ratio": 0 <= config.warmup_ratio <= 1,
        }
    wrong = [f"{name}={getattr(config, name)!r}" for name, fine in rules.items() if not fine]
    if wrong:
        raise ValueError(f"unsupported settings: {', '.join(wrong)}")
    return config
