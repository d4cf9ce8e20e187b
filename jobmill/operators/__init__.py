"""jobmill.operators"""
