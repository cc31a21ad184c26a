"""plumbline: Spark-native labelling, cleaning, scoring and reporting for work-item text."""
