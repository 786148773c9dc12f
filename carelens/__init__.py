"""carelens: data-quality scoring of clinical tables on Spark.

Raw admissions, diagnoses and vital-sign readings are cleaned (staging),
pivoted and rolled up (marts), checked, scored for anomalies and trust, and
the least trusted admissions are prepared for review.  Every step is a
DataFrame -> DataFrame function; nothing is collected to the driver except
fixed-size model parameters.
"""

__version__ = "0.1.0"
