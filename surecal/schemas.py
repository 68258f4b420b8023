"""Schemas of the tables that are read and written."""

from __future__ import annotations

MANIFEST = "csv_file string, prompt string, dataset string, model string"
GSM8K_OUTPUTS = (
    "index bigint, question string, answer string, content string, thinking string, "
    "prediction string, logprobs array<double>, verb_conf double"
)
ARC_OUTPUTS = (
    "id string, question string, answer string, labels array<string>, content string, "
    "thinking string, prediction string, label_probs array<double>, verb_conf double"
)
RUN_METADATA = (
    "model string, dataset string, dataset_config string, batch_size int, thinking boolean, "
    "timestamp string, device string, max_samples int, system_prompt string, git_commit string"
)
ARC_QUESTIONS = (
    "id string, question string, choices struct<text: array<string>, label: array<string>>, "
    "answerKey string"
)
