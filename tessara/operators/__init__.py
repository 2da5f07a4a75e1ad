"""Estimators, metrics, splitters, target checks and validators."""

from .classification import accuracy_score, confusion_matrix, f1_score, log_loss, precision_score, recall_score
from .linear_model import LinearRegression, Ridge
from .model_selection import KFold, StratifiedKFold, train_test_split
from .preprocessing import LabelEncoder, MinMaxScaler, Normalizer, StandardScaler
from .regression import explained_variance_score, mean_absolute_error, mean_absolute_percentage_error, mean_squared_error, r2_score
from .targets import check_classification_targets, class_count, compute_class_weight, compute_sample_weight, is_binary_classification, is_multilabel, type_of_target, unique_labels
from .validation import as_doubles, as_integers, check_array, check_features_consistency, check_xy, num_features, sample_weight

__all__ = [n for n in dir() if not n.startswith("_")]
