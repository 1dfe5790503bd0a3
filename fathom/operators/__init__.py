"""fathom.operators"""
