"""The line classifier: n-gram TF-IDF and hand-made features with logistic regression."""

from .evaluate import capture_rate, confusion, keyword_capture
from .labeling import label_windows, new_datasets, remap_labels, sample_evenly, sample_unmarked, split_bgl, validate_labels, with_previous
from .scoring import LineModel, score_lines
from .training import train_model

__all__ = ["LineModel", "capture_rate", "confusion", "keyword_capture", "label_windows", "new_datasets", "remap_labels", "sample_evenly", "sample_unmarked", "score_lines", "split_bgl", "train_model", "validate_labels", "with_previous"]
