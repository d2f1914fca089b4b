"""Settings and hyperparameter presets."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Config:
    """strict reproduces the known oddities of each raw format; otherwise the evident intent holds.  dataset_size 0: all of it.  shards: of
    each split; of one that isn't named, as many as its examples need."""

    vocabulary_size: int = 16384
    name_vocabulary_size: int = 3000
    dataset_size: int = 0
    dataset_split: dict[str, int] = field(default_factory=lambda: {"train": 80, "val": 10, "test": 10})
    shards: dict[str, int] = field(default_factory=dict)
    packed_length: int = 0
    opensubtitles_year: int = 2012
    strict: bool = False

    def key(self) -> str:
        """Names outputs, so that a changed setting never meets an old table."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


# presets' overrides, each on top of the one it is made from.
_TRANSFORMER = {"roulette": "Normal", "roulette_beam_size": 100, "batch_size": 4096, "layer_prepostprocess_dropout": 0.4, "symbol_modality_num_shards": 16, "attention_dropout": 0.2, "relu_dropout": 0.2, "summarize_vars": True}
_SEQ2SEQ = {"clip_grad_norm": 0.0, "shared_embedding_and_softmax_weights": True, "optimizer": "Adafactor", "use_fixed_batch_size": False, "summarize_vars": True, "symbol_modality_num_shards": 10, "hidden_size": 2048, "num_hidden_layers": 2, "batch_size": 512, "max_length": 64}


def presets() -> dict[str, dict]:
    out: dict[str, dict] = {f"general_{k}_hparams": dict(_TRANSFORMER) for k in ("transformer", "roulette_transformer", "extracted_transformer")}
    base = {"learning_rate_warmup_steps": 16000}
    out["chatbot_cornell_base"] = base
    for k in (32, 16, 8, 4, 2):
        out[f"chatbot_transformer_batch_{k}k"] = base | {"batch_size": 1024 * k}
    for layer, inner in ((20, 10), (40, 20), (50, 30), (70, 50)):
        drop = {"layer_prepostprocess_dropout": layer / 100, "attention_dropout": inner / 100, "relu_dropout": inner / 100}
        out[f"base_trf_{layer}_{inner}_drop"] = out["chatbot_transformer_batch_2k"] | drop
    out |= {f"general_{k}_hparams": dict(_SEQ2SEQ) for k in ("gradient_checkpointed_seq2seq", "extracted_seq2seq", "lstm_seq2seq")}
    big = _SEQ2SEQ | {"batch_size": 8192}
    out["chatbot_lstm_batch_8k"] = big
    for k in (1, 4, 8, 32, 40, 64, 128, 256, 512, 1024, 2048):
        out[f"chatbot_lstm_batch_{k}"] = big | {"batch_size": k}
    out["chatbot_lstm_hparams"] = out["chatbot_lstm_batch_256"] | {"hidden_size": 3072}
    return out


def preset_rows() -> list[tuple[str, str, str]]:
    return [(p, k, str(v)) for p, d in sorted(presets().items()) for k, v in sorted(d.items())]


def default_preset(model: str, name: str | None) -> str:
    """The preset's name: as given, else the model's general one."""
    return name or f"general_{model}_hparams"


#: Checkpoints of a sweep.
SWEEP = (1, 1328, 2647, 3963, 5284, 6611, 7932, 9254, 10581, 11902, 13227, 14558, 15882, 17209)
