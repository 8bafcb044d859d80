"""loomframe.sources"""
