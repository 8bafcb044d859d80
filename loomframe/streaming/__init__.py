"""loomframe.streaming"""
