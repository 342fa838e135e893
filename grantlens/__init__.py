"""grantlens: Spark-native analytics for housing-subsidy application records.

Cleaning, history statistics, feature engineering, approval classifiers,
batch/stream scoring with risk bands, municipality clustering, year
sequences and text analysis, all expressed as DataFrame jobs.
"""

__version__ = "0.1.0"
