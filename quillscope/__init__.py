"""quillscope: a PySpark-native engine for text stylometry, event graphs and corpus upkeep."""

__version__ = "0.1.0"
