"""loomframe.functions"""
