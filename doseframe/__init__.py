"""Spark-native dose/response modelling data: DataFrame transformations and Column builders."""
