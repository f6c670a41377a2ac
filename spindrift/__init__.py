"""Spark-native multimodal retrieval, corpus analytics and corpus preparation."""
