"""loomframe.operators"""
