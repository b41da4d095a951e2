"""Spark-native analytics over corpora of decompiled functions."""
